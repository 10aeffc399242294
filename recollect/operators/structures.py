"""Tree structures as queries: hash trees, prefixes, cumulative sums, boxes, and a simulated cache."""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def chain_head(df: DataFrame, group: str, order: str, row: Column, seed: Column) -> DataFrame:
    """(group, head, n): sha256(head || row hash) folded over the rows in order, from `seed`; all as hex text.

    A chain is sequential by its nature: a group's row hashes (64 characters each) meet in one task. Use merkle_root
    where a group may be large.
    """
    h = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(row, 256).alias("h")))).alias("rows"))
    head = F.aggregate("rows", seed, lambda a, x: F.sha2(F.concat(a, x["h"]), 256))
    return h.select(group, head.alias("head"), F.size("rows").cast("long").alias("n"))


def merkle_levels(leaves: DataFrame, group: str) -> list[DataFrame]:
    """Levels (group, idx, hash) of each group's tree, leaves first; a node is sha256(left || right), an odd one doubles.

    leaves have (group, idx from 0, hash). Each level is one aggregation of half the rows, so no group is gathered, and
    is written once, as it is read again for the next one, the roots and the proofs.
    """
    scratch = Scratch(leaves.sparkSession)
    levels = [scratch.write(leaves.select(group, F.col("idx").cast("long").alias("idx"), "hash"), "level0")]
    top = levels[0].agg(F.max("idx")).first()[0]
    while top:
        cur = levels[-1].groupBy(group, F.expr("idx div 2").alias("idx")).agg(F.min_by("hash", "idx").alias("l"), F.max_by("hash", "idx").alias("r"), F.max("idx").alias("m"))
        levels.append(scratch.write(cur.select(group, "idx", F.sha2(F.concat("l", "r"), 256).alias("hash")), f"level{len(levels)}"))
        top //= 2
    return levels


def merkle_root(leaves: DataFrame, group: str) -> DataFrame:
    """(group, root); a group's root is the first level at which it has one node."""
    levels, out = merkle_levels(leaves, group), None
    sizes = levels[0].groupBy(group).agg(F.max("idx").alias("_top"))
    for d, level in enumerate(levels):
        done = sizes.filter(F.when(F.col("_top") == 0, 0).otherwise(F.length(F.bin("_top"))) == d).select(group)
        r = level.join(done, group, "left_semi").select(group, F.col("hash").alias("root"))
        out = r if out is None else out.unionByName(r)
    return out


def merkle_proof(leaves: DataFrame, group: str) -> DataFrame:
    """(group, leaf, level, sibling, side): each leaf's path; an unpaired node is its own right sibling, so every proof verifies."""
    levels = merkle_levels(leaves, group)
    paths = None
    base = levels[0].select(group, F.col("idx").alias("leaf"))
    for d, level in enumerate(levels[:-1]):
        at = base.withColumn("pos", F.shiftright(F.col("leaf"), d)).withColumn("sib", F.col("pos").bitwiseXOR(F.lit(1)))
        own = level.select(group, F.col("idx").alias("pos"), F.col("hash").alias("_own"))
        other = level.select(group, F.col("idx").alias("sib"), F.col("hash").alias("_other"))
        tops = level.groupBy(group).agg(F.max("idx").alias("_top")).filter("_top > 0").select(group)
        p = at.join(tops, group, "left_semi").join(own, [group, "pos"]).join(other, [group, "sib"], "left")
        side = F.when(F.col("_other").isNull() | (F.col("pos") % 2 == 0), "right").otherwise("left")
        p = p.select(group, "leaf", F.lit(d).alias("level"), F.coalesce("_other", "_own").alias("sibling"), side.alias("side"))
        paths = p if paths is None else paths.unionByName(p)
    return paths if paths is not None else base.select(group, "leaf", F.lit(0).alias("level"), F.lit("").alias("sibling"), F.lit("").alias("side")).limit(0)


def prefix_matches(keys: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys that begin with `prefix`: a filter that reaches the scan."""
    return keys.filter(F.startswith(F.col(key), F.lit(prefix)))


def autocomplete(keys: DataFrame, prefix: str, limit: int = 10, key: str = "key") -> DataFrame:
    return prefix_matches(keys, prefix, key).select(key).distinct().orderBy(key).limit(limit)


def prefix_counts(keys: DataFrame, prefixes: DataFrame, key: str = "key") -> DataFrame:
    """(prefix, n): distinct keys under each prefix; joined on the prefix's length and text, so by equality."""
    lens = prefixes.select(F.length("prefix").alias("n")).distinct()
    cut = keys.select(F.col(key).alias("k")).distinct().join(F.broadcast(lens), F.length("k") >= F.col("n")).select(F.substring("k", F.lit(1), F.col("n")).alias("prefix"))
    return prefixes.join(cut.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")), "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


#: Rows of one block of a cumulative sum; there are as many blocks as this asks for.
BLOCK_ROWS = 250_000


def _in_blocks(df: DataFrame, scratch: Scratch, name: str, *order: Column | str) -> tuple[DataFrame, int]:
    """`df` with `_b`, stored: blocks of about equal numbers of rows in the given order, whatever its values are.

    Borders are quantiles of a sample, so one far value, or most rows in a narrow range, make no block larger.
    """
    n = max(1, -(-df.count() // BLOCK_ROWS))
    return scratch.write(df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id()), name, rows=10_000), n


def prefix_sums(points: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    """(idx, sum, prefix_sum): sums up to each index, in two levels: a block starts at the sum of the blocks before, which
    are few, and inside a block a window runs. Nulls come first."""
    scratch = Scratch(points.sparkSession)
    per, _ = _in_blocks(points.groupBy(F.col(idx).alias("idx")).agg(F.sum(value).alias("sum")), scratch, "sums", "idx")
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.groupBy("_b").agg(F.sum("sum").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy("idx")
    return per.join(F.broadcast(starts), "_b").select("idx", "sum", (F.col("_start") + F.sum("sum").over(inside)).alias("prefix_sum"))


def _as_of(sums: DataFrame, asked: DataFrame, at: str, out: str) -> DataFrame:
    """`asked` with `out`: the prefix_sum of the last idx <= `at` (0 if none is). Both sides are merged by idx in blocks
    of equal numbers of rows; a block opens with the last sum of those before, so the work is linear, questions that
    share a place are several tasks' work, and nothing is broadcast but the blocks' last sums."""
    scratch = Scratch(sums.sparkSession)
    s = sums.select(F.col("idx").alias("_i"), F.lit(0).alias("_asked"), "prefix_sum", *[F.lit(None).cast(f.dataType).alias(f.name) for f in asked.schema])
    a = asked.select(F.col(at).alias("_i"), F.lit(1).alias("_asked"), F.lit(None).cast(sums.schema["prefix_sum"].dataType).alias("prefix_sum"), *asked.columns)
    both, n = _in_blocks(s.unionByName(a), scratch, "both", "_i", "_asked", F.xxhash64(*asked.columns))
    w = Window.partitionBy("_b").orderBy("_i", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_here", F.last("prefix_sum", True).over(w)).filter("_asked = 1")
    ends = both.filter("_asked = 0").groupBy(F.col("_b").alias("_e")).agg(F.max_by("prefix_sum", "_i").alias("_end"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = sums.sparkSession.range(n).select(F.col("id").cast("int").alias("_b")).join(ends, F.col("_b") == F.col("_e"), "left")
    opens = blocks.select("_b", F.last("_end", True).over(before).alias("_open"))
    return here.join(F.broadcast(opens), "_b", "left").select(*asked.columns, F.coalesce("_here", "_open", F.lit(0)).alias(out))


def range_sums(points: DataFrame, ranges: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    """(lo, hi, total): the sum of each range, 0 for an inverted one: the prefix sum at hi less that before lo."""
    p = prefix_sums(points, idx, value).select("idx", "prefix_sum")
    r = ranges.select("lo", "hi").withColumn("_l", F.col("lo") - 1)
    r = _as_of(p, _as_of(p, r, "hi", "_to"), "_l", "_from")
    return r.select("lo", "hi", F.when(F.col("lo") <= F.col("hi"), F.col("_to") - F.col("_from")).otherwise(0).alias("total"))


def find_kth(points: DataFrame, ks: DataFrame, capacity: int, idx: str = "idx", value: str = "value") -> DataFrame:
    """(k, idx): the least index whose prefix sum reaches k, `capacity` if none does (values are not negative).

    The same merge, with prefix sums as the order and read from above: the next index for the sums from k on.
    """
    p = prefix_sums(points, idx, value).groupBy("prefix_sum").agg(F.min("idx").alias("idx"))
    p = p.select((-F.col("prefix_sum")).alias("idx"), F.col("idx").alias("prefix_sum"))
    out = _as_of(p, ks.select("k", (-F.col("k")).alias("_k")), "_k", "_at")
    top = -(p.agg(F.min("idx")).first()[0] or 0)
    return out.select("k", F.coalesce(F.when(F.col("k") <= F.lit(top), F.col("_at")), F.lit(capacity)).alias("idx"))


def has_key(keys: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """(probe, found): whether each probed text is a key as a whole."""
    have = keys.select(F.col(key).alias("probe")).distinct().withColumn("found", F.lit(True))
    return probes.select("probe").distinct().join(have, "probe", "left").select("probe", F.coalesce("found", F.lit(False)).alias("found"))


def point_values(points: DataFrame, asked: DataFrame, capacity: int, idx: str = "idx", value: str = "value") -> DataFrame:
    """(idx, total): the sum at single indexes from 1 to `capacity`; 0 where nothing was added, no row for others."""
    per = points.groupBy(F.col(idx).alias("idx")).agg(F.sum(value).alias("total"))
    return asked.select("idx").distinct().filter(F.col("idx").between(1, capacity)).join(per, "idx", "left").select("idx", F.coalesce("total", F.lit(0)).alias("total"))


def _box(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("min_x", "min_y", "max_x", "max_y")}


def expansion(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """By how much the area of `a` grows when it takes in `b`."""
    both = {c: F.least(a[c], b[c]) if c.startswith("min") else F.greatest(a[c], b[c]) for c in a}
    return area(both) - area(a)


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes meet; touching counts."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def contains(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["min_x"] <= b["min_x"]) & (a["min_y"] <= b["min_y"]) & (a["max_x"] >= b["max_x"]) & (a["max_y"] >= b["max_y"])


def contains_point(a: dict[str, Column], x: Column, y: Column) -> Column:
    return x.between(a["min_x"], a["max_x"]) & y.between(a["min_y"], a["max_y"])


def area(b: dict[str, Column]) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def box_join(boxes: DataFrame, queries: DataFrame, cell: float) -> DataFrame:
    """(query_id, id): boxes that meet or touch each query box. Both are dealt into grid cells of side `cell` and joined
    on the cell; a pair counts in the cell that holds the lower corner of its overlap, so once."""
    lo = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("cx", F.explode(F.sequence(lo("min_x"), lo("max_x")))).withColumn("cy", F.explode(F.sequence(lo("min_y"), lo("max_y"))))
    q = cells(queries.select("query_id", "min_x", "min_y", "max_x", "max_y")).withColumnsRenamed({c: f"q_{c}" for c in ("min_x", "min_y", "max_x", "max_y")})
    j = cells(boxes.select("id", "min_x", "min_y", "max_x", "max_y")).join(q, ["cx", "cy"])
    meet = (F.col("min_x") <= F.col("q_max_x")) & (F.col("max_x") >= F.col("q_min_x")) & (F.col("min_y") <= F.col("q_max_y")) & (F.col("max_y") >= F.col("q_min_y"))
    corner = lambda a, b: F.floor(F.greatest(a, b) / F.lit(cell)).cast("long")
    once = (corner("min_x", "q_min_x") == F.col("cx")) & (corner("min_y", "q_min_y") == F.col("cy"))
    return j.filter(meet & once).select("query_id", "id")


def nearest_boxes(boxes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the k boxes whose centres are nearest to each query's point, ties by id.

    Centres are in a grid, and a query looks at its cell and the eight around it. While these hold fewer than k, it looks
    again in cells of twice the side. The kth distance then bounds the answer: if it is under the side, no cell left
    out can hold a nearer centre; else one last look, in cells of at least that side, is enough. Queries and cells are
    joined by equality, so no query meets all boxes.
    """
    scratch = Scratch(boxes.sparkSession)
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    centres = scratch.write(boxes.select("id", cx.alias("cx"), cy.alias("cy")).filter("cx is not null and cy is not null"), "centres", rows=10_000)
    pending = scratch.write(queries.select("query_id", "x", "y"), "asked", rows=10_000)
    both = centres.select(F.col("cx").alias("x"), F.col("cy").alias("y")).unionByName(pending.select("x", "y"))
    span = both.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    n, span = centres.count(), max(span["w"] or 0.0, span["h"] or 0.0, 1e-9)
    if k < 1 or not n:
        return boxes.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    side = span / max(1.0, math.sqrt(n / (2 * k)))
    best = Window.partitionBy("query_id").orderBy("distance", "id")

    def look(asked: DataFrame, levels: list[int]) -> DataFrame:
        """The k nearest centres of the nine cells around each query (query_id, x, y, level)."""
        at = lambda c, level: F.floor(F.col(c) / (F.lit(side) * F.pow(F.lit(2.0), level))).cast("long")
        cells = centres.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]))).withColumns({"gx": at("cx", F.col("level")), "gy": at("cy", F.col("level"))})
        ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        probes = asked.withColumn("d", ring).withColumns({"gx": at("x", F.col("level")) + F.col("d.i"), "gy": at("y", F.col("level")) + F.col("d.j")})
        near = probes.join(cells, ["level", "gx", "gy"]).withColumn("distance", F.sqrt(F.pow(F.col("cx") - F.col("x"), 2) + F.pow(F.col("cy") - F.col("y"), 2)))
        return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")

    done, last, final = [], math.ceil(math.log2(max(1.0, span / side))) + 1, []
    for level in range(last + 1):
        found = scratch.write(look(pending.withColumn("level", F.lit(level)), [level]), f"found{level}", rows=10_000)
        if level == last:  # a cell is as wide as everything
            done.append(found)
            break
        reach = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).filter(F.col("n") >= k)
        wide = F.when(F.col("far") < side * 2.0**level, level).otherwise(F.least(F.lit(last), F.floor(F.log2(F.col("far") / side)) + 1)).cast("int")
        reach = scratch.write(reach.select("query_id", wide.alias("level")), f"reach{level}", rows=10_000)
        done.append(found.join(reach.filter(F.col("level") == level), "query_id", "left_semi"))
        final.append(pending.join(reach.filter(F.col("level") > level), "query_id"))
        pending = scratch.write(pending.join(reach, "query_id", "left_anti"), f"pending{level}", rows=10_000)
        if pending.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    again = scratch.write(reduce(DataFrame.unionByName, final), "again", rows=10_000) if final else None
    levels = sorted(r["level"] for r in again.select("level").distinct().collect()) if again is not None else []
    return out.unionByName(look(again, levels)) if levels else out


def bounding_box(boxes: DataFrame, *by: str) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def lru_simulation(log: DataFrame, capacity: int = 500) -> DataFrame:
    """(cache, hits, misses, evictions, hit_rate) of an access log (cache, seq, key): the least recently used key goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, hits, misses, gone = OrderedDict(), 0, 0, 0
        for key in pdf.sort_values("seq")["key"]:
            if key in held:
                held.move_to_end(key)
                hits += 1
                continue
            misses += 1
            held[key] = None
            if len(held) > capacity:
                held.popitem(last=False)
                gone += 1
        return pd.DataFrame([(pdf["cache"].iloc[0], hits, misses, gone, hits / max(1, hits + misses))], columns=["cache", "hits", "misses", "evictions", "hit_rate"])

    kind = log.schema["cache"].dataType.simpleString()
    return log.groupBy("cache").applyInPandas(run, f"cache {kind}, hits long, misses long, evictions long, hit_rate double")
