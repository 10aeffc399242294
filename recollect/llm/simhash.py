"""SimHash near-duplicates by a Gray-order hierarchical index (operator 3).

Top nodes hold fingerprints that share the bits of a fixed mask; below one, fingerprints are in Gray order, and each
level factors the bits that neighbours share into a node above them, up to one root. Two nodes differ in at least the
bits that both factored and that differ; on the way down only bits that are new at a level are added, and pairs of
nodes that have come to more than DISTANCE are dropped with everything below.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, table, text_key

SHINGLE, SEED, DISTANCE = 4, 42, 4
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at once; bounds memory for very long texts.
CHUNK = 1 << 16
#: Top nodes: 64 bits in parts; within DISTANCE differing bits all but DISTANCE parts are equal. With more parts a top
#: node shares more bits, so for more fingerprints there are more: the fewest with at most ROWS_A_NODE rows a random node.
FEWEST_PARTS, MOST_PARTS, ROWS_A_NODE = 6, 10, 4
#: Rows of one top node that a task reads together; a larger one is dealt into parts, each pair of parts to a task.
PART = 4096
#: Nodes under one node of the tree below a top node.
FAN = 8
#: Pairs of nodes that are opened at once; bounds memory.
PAIRS = 1 << 18


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of a text: majority over its word shingles' XXH64, 0 without words."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for c in range(0, n, CHUNK):
        part = words[c : c + CHUNK + width - 1]
        grams = [b" ".join(part)] if len(part) < width else map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        b = h.view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(b, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text")
        fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("th")], ["doc_id", "fp", "th"])


def masks(segments: int = FEWEST_PARTS, distance: int = DISTANCE) -> list[int]:
    """The masks of the top nodes: each choice of all but `distance` of the `segments` parts of 64 bits."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, segments - distance)]


def segments_for(rows: int) -> int:
    """How many parts 64 bits are cut into for so many fingerprints."""
    for s in range(FEWEST_PARTS, MOST_PARTS):
        if rows <= ROWS_A_NODE << (64 * (s - DISTANCE) // s):
            return s
    return MOST_PARTS


def gray_rank(x: Column) -> Column:
    """The place of a value in the reflected Gray code: neighbours in this order differ in few bits."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


class Level(NamedTuple):
    """Nodes of one level: the bits that all fingerprints below share (mask and pattern), and where the children are."""

    mask: np.ndarray
    pattern: np.ndarray
    child: np.ndarray
    end: np.ndarray


def hierarchy(cell: np.ndarray, fp: np.ndarray) -> list[Level]:
    """The levels over fingerprints in Gray order by cell (a number for each top node), fingerprints first, roots last."""
    n = len(fp)
    levels = [Level(np.full(n, ~np.uint64(0)), fp, np.arange(n), np.arange(n))]
    all_, any_ = fp, fp
    while True:
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[start, len(cell)])
        if size.max(initial=0) <= 1 and len(levels) > 1:
            return levels
        place = np.arange(len(cell)) - np.repeat(start, size)
        at = np.flatnonzero(place % FAN == 0)
        all_, any_ = np.bitwise_and.reduceat(all_, at), np.bitwise_or.reduceat(any_, at)
        levels.append(Level(~(all_ ^ any_), all_, at, np.r_[at[1:], len(cell)]))
        cell = cell[at]


def links(cell: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of fingerprints of one cell within `distance` differing bits; rows are in Gray order by cell."""
    if not len(fp):
        return
    levels = hierarchy(cell, fp)
    roots = np.flatnonzero(levels[-1].end - levels[-1].child > 0)
    todo = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.uint8))]
    while todo:
        k, a, b, acc = todo.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            todo += [(k, a[:half], b[:half], acc[:half]), (k, a[half:], b[half:], acc[half:])]
            continue
        up, low = levels[k], levels[k - 1]
        na, nb = up.end[a] - up.child[a], up.end[b] - up.child[b]
        each = na * nb
        pair = np.repeat(np.arange(len(a)), each)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, y = up.child[a][pair] + inner // nb[pair], up.child[b][pair] + inner % nb[pair]
        keep = x <= y if k > 1 else x < y
        x, y, pair = x[keep], y[keep], pair[keep]
        counted = (up.mask[a] & up.mask[b])[pair]  # these bits' differences are in acc
        new = low.mask[x] & low.mask[y] & ~counted
        got = acc[pair] + np.bitwise_count((low.pattern[x] ^ low.pattern[y]) & new)
        near = got <= distance
        x, y, got = x[near], y[near], got[near]
        if k == 1:
            yield x, y
        elif len(x):
            todo.append((k - 1, x, y, got))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[root]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell as four numbers, fp) by cell and Gray rank: edges (a, b) that join each cell's linked fingerprints, as stars.

    Only the rows of one cell are held beyond a batch; a cell has at most two parts' rows.
    """

    def edges(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        number = np.cumsum(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        root = np.arange(len(fp))
        for x, y in links(number, fp):
            root = _forest(len(fp), np.r_[np.arange(len(fp)), x], np.r_[root, y])
        star = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[star]].view(np.int64)), pa.array(fp[star].view(np.int64))], ["a", "b"])

    rest_c, rest_f = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
    for b in batches:
        c = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        c, f = np.concatenate([rest_c, c]), np.concatenate([rest_f, b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(f):
            continue
        last = int(np.flatnonzero(np.r_[True, (c[1:] != c[:-1]).any(axis=1)])[-1])
        if last:
            yield edges(c[:last], f[:last])
        rest_c, rest_f = c[last:], f[last:]
    if len(rest_f):
        yield edges(rest_c, rest_f)


def linked(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that keep the components of "at most DISTANCE bits differ".

    Two fingerprints that link share the bits of at least one of the masks, so each is put under its top node of every
    mask, and only top nodes with two or more are read, in Gray order. Those of more than PART rows are dealt into
    parts and read pair of parts by pair of parts; none is cut.
    """
    cell = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(segments_for(fps.count()))])).alias("mask", "pattern")
    nodes = fps.select("fp", cell)
    sizes = nodes.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = nodes.join(sizes, ["mask", "pattern"])
    parts = F.ceil(F.col("n") / F.lit(PART // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))).alias("pair")
    rows = rows.withColumn("parts", parts).select("mask", "pattern", "fp", pair)
    rows = rows.select("mask", "pattern", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp")
    rows = rows.repartition("mask", "pattern", "i", "j").sortWithinPartitions("mask", "pattern", "i", "j", gray_rank(F.col("fp")))
    return scratch.write(rows.mapInArrow(_cells, "a long, b long"), "edges", rows=50_000)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64-bit fingerprint as a long), component_id (the smallest doc_id reachable), root (one fingerprint of the component, the same for all of it) and th (the text's key) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat an id are one document of that
    component; null ids take part, and a component of null ids alone has a null component_id. Equal fingerprints are
    linked as one node, so copies cost nothing beyond their row. Texts of any length are read whole; an empty table
    gives no rows. Columns of other names are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), text_key(F.col(text_col)).alias("th"))
    fp = scratch.write(src.mapInArrow(_fingerprints, "doc_id long, fp long, th long"), "fp")
    distinct = scratch.write(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(linked(distinct.select("fp"), scratch), scratch)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = scratch.write(named.join(least, "root").select("fp", "component_id", "root"), "label")
    return fp.join(label, "fp").select("doc_id", "fp", "component_id", "root", "th")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
