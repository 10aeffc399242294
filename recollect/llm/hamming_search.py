"""Exact top-k search over binary codes by incremental multi-index hashing (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Segments of a 64-bit code, and their bits.
SEGMENTS, WIDTH = 4, 16
TOP_K = 10
#: Parts that what a query finds is dealt to before its k best are taken, so that one query is no one task's.
PARTS = 16


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is set if component i (of the first 64) is positive; null components count as not."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _segments(code: Column) -> Column:
    return F.posexplode(F.array(*[_segment(code, s) for s in range(SEGMENTS)])).alias("segment", "value")


def _flips(radius: int) -> Column:
    """All segment patterns of `radius` set bits, as one constant."""
    return F.split(F.lit(",".join(str(x) for x in range(1 << WIDTH) if x.bit_count() == radius)), ",").cast("array<int>")


def _best(df: DataFrame, k: int) -> DataFrame:
    """The k best of each query, first in PARTS parts and then of these."""
    order = ("distance", "neighbour_id", "tie")
    part = F.pmod(F.xxhash64("neighbour_id", "tie"), F.lit(PARTS))
    some = df.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query_code", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_code").orderBy(*order))).filter(F.col("rank") <= k)


def top_k(codes: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k codes nearest to each query in Hamming distance, ties by id.

    codes and queries have (id, code); columns of other names are not read. Rows of null code are in neither; a null
    id ranks first among ties, and rows that repeat an id are neighbours of their own. A repeated query is answered
    once. Fewer than k codes are all returned; an empty side gives no rows.

    Codes are indexed under each of their segments. Round r probes the segment values at exactly r flipped bits and
    verifies what it finds. After round r every code within SEGMENTS * (r + 1) - 1 bits has been seen, as a farther
    one differs in more than r bits in each segment; a query whose kth distance is within that is finished, the rest
    go on, and of what they find only codes at most as far as their kth so far are kept. A code counts in the first round
    and segment that find it, so nothing is verified twice. Equal codes are one entry with its k smallest ids, which is
    all that any answer can use, and queries of one code are searched once and share the answer.
    """
    spark = codes.sparkSession
    scratch = Scratch(spark)
    own = Window.partitionBy("code").orderBy("neighbour_id", "tie")
    rows = codes.filter(F.col("code").isNotNull()).select(F.col("id").alias("neighbour_id"), "code", F.lit(0).alias("tie"))
    few = rows.withColumn("i", F.row_number().over(own)).filter(F.col("i") <= k)
    few = scratch.write(few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("neighbour_id", F.col("i").alias("tie")))).alias("ids")), "codes")
    index = scratch.write(few.select("code", _segments(F.col("code"))).sort("segment", "value"), "index")
    asked = scratch.write(queries.filter(F.col("code").isNotNull()).select(F.col("id").alias("query_id"), F.col("code").alias("query_code")).distinct(), "queries")
    active = scratch.write(asked.select("query_code", F.lit(64).alias("bound")).distinct(), "active")
    done = best = None
    for radius in range(WIDTH + 1):
        probe = active.select("query_code", "bound", _segments(F.col("query_code"))).withColumn("flip", F.explode(_flips(radius)))
        probe = probe.select("query_code", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        diff = F.col("code").bitwiseXOR(F.col("query_code"))
        first = F.bit_count(diff) <= F.col("bound")
        for s in range(SEGMENTS):
            d = F.bit_count(_segment(diff, s))
            first &= (d > radius) | ((d == radius) & (F.lit(s) >= F.col("segment")))
        hit = index.join(probe.hint("merge"), ["segment", "value"]).filter(first).select("query_code", "code", F.bit_count(diff).alias("distance"))
        found = hit.join(few.hint("merge"), "code").select("query_code", "distance", F.explode("ids").alias("x")).select("query_code", "distance", "x.neighbour_id", "x.tie")
        if best is not None:
            found = found.unionByName(best.join(active, "query_code", "left_semi").select("query_code", "distance", "neighbour_id", "tie"))
        best = scratch.write(_best(found, k), f"best{radius}")
        covered = SEGMENTS * (radius + 1) - 1
        kth = best.groupBy("query_code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        sure = kth.filter((F.col("n") >= k) & (F.col("kth") <= covered)).select("query_code")
        last = radius == WIDTH
        ready = best if last else best.join(sure, "query_code", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        limit = kth.select("query_code", F.when(F.col("n") >= k, F.col("kth")).otherwise(64).alias("new"))
        go_on = active.join(sure, "query_code", "left_anti").join(limit, "query_code", "left")
        active = scratch.write(go_on.select("query_code", F.coalesce("new", "bound").alias("bound")), f"active{radius}")
        if active.isEmpty():
            break
    return asked.join(done, "query_code").select("query_id", "rank", "neighbour_id", "distance")


def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.filter("id % 100 = 0"))


OP2_SQL = """
WITH c AS (
  SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS UBIGINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS UBIGINT) END)) AS UBIGINT) AS code
  FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM c q CROSS JOIN c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
