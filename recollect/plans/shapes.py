"""Queries on tree structures, hashing, migration and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import migration as Q
from ..operators import structures as S
from . import views as W

QUERIES, SQL = {}, {}


def _keys(spark, sf):
    return W.table(spark, sf, "part").select(F.col("p_name").alias("key"))


def trie_prefix(spark, sf):
    """Part names under the three first letters of any part of size 1."""
    p = W.table(spark, sf, "part").filter("p_size = 1").select(F.substring("p_name", 1, 3).alias("prefix")).distinct()
    return _keys(spark, sf).distinct().join(p, F.substring("key", 1, 3) == F.col("prefix")).select("prefix", "key")


SQL["trie_prefix"] = "SELECT DISTINCT prefix, p_name AS key FROM part JOIN (SELECT DISTINCT substr(p_name, 1, 3) AS prefix FROM part WHERE p_size = 1) ON starts_with(p_name, prefix)"


def trie_count_prefix(spark, sf):
    p = _keys(spark, sf).select(F.explode(F.array(F.substring("key", 1, 1), F.substring("key", 1, 3), F.substring("key", 1, 6))).alias("prefix")).distinct()
    return S.prefix_counts(_keys(spark, sf), p)


SQL["trie_count_prefix"] = "WITH p AS (SELECT DISTINCT unnest([substr(p_name, 1, 1), substr(p_name, 1, 3), substr(p_name, 1, 6)]) AS prefix FROM part) SELECT prefix, count(DISTINCT p_name) AS n FROM p JOIN part ON starts_with(p_name, prefix) GROUP BY prefix"


def trie_autocomplete(spark, sf):
    return S.autocomplete(_keys(spark, sf), "b", 10)


SQL["trie_autocomplete"] = "SELECT DISTINCT p_name AS key FROM part WHERE starts_with(p_name, 'b') ORDER BY key LIMIT 10"


def _points(spark, sf):
    return W.table(spark, sf, "orders").select(F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("idx"), F.lit(1).cast("long").alias("value"))


_PTS = "pts AS (SELECT CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS idx FROM orders)"


def fenwick_prefix_sum(spark, sf):
    return S.prefix_sums(_points(spark, sf))


SQL["fenwick_prefix_sum"] = f"WITH {_PTS}, g AS (SELECT idx, count(*) AS sum FROM pts GROUP BY idx) SELECT idx, sum, CAST(sum(sum) OVER (ORDER BY idx) AS BIGINT) AS prefix_sum FROM g"


def _ranges(spark):
    return spark.range(40).select((F.col("id") * 100).alias("lo"), (F.col("id") * 100 + (F.col("id") - 5) * 30).alias("hi"))


def fenwick_range_sum(spark, sf):
    return S.range_sums(_points(spark, sf), _ranges(spark))


SQL["fenwick_range_sum"] = f"WITH {_PTS}, r AS (SELECT i * 100 AS lo, i * 100 + (i - 5) * 30 AS hi FROM range(40) t(i)) SELECT lo, hi, (SELECT count(*) FROM pts WHERE idx BETWEEN lo AND hi) AS total FROM r"


def fenwick_kth(spark, sf):
    ks = spark.range(1, 60).select((F.col("id") * 307).alias("k"))
    return S.find_kth(_points(spark, sf), ks, 100_000).select("k", F.col("idx").cast("long").alias("idx"))


SQL["fenwick_kth"] = f"WITH {_PTS}, g AS (SELECT idx, sum(count(*)) OVER (ORDER BY idx) AS c FROM pts GROUP BY idx), ks AS (SELECT i * 307 AS k FROM range(1, 60) t(i)) SELECT k, coalesce((SELECT min(idx) FROM g WHERE c >= k), 100000) AS idx FROM ks"


def _boxes(spark, sf):
    k = F.col("p_partkey")
    x, y = (k * 37) % 1000, (k * 91) % 1000
    return W.table(spark, sf, "part").select(k.alias("id"), x.cast("double").alias("min_x"), y.cast("double").alias("min_y"), (x + F.col("p_size") % 20).cast("double").alias("max_x"), (y + k % 15).cast("double").alias("max_y"))


_BOX = "box AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS min_x, CAST((p_partkey * 91) % 1000 AS DOUBLE) AS min_y, CAST((p_partkey * 37) % 1000 + p_size % 20 AS DOUBLE) AS max_x, CAST((p_partkey * 91) % 1000 + p_partkey % 15 AS DOUBLE) AS max_y FROM part)"


def spatial_range(spark, sf):
    b = _boxes(spark, sf)
    q = b.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "min_x", "min_y", (F.col("max_x") + 50).alias("max_x"), (F.col("max_y") + 50).alias("max_y"))
    return S.box_join(b, q, 32.0)


SQL["spatial_range"] = f"WITH {_BOX} SELECT q.id AS query_id, b.id FROM box q JOIN box b ON b.min_x <= q.max_x + 50 AND b.max_x >= q.min_x AND b.min_y <= q.max_y + 50 AND b.max_y >= q.min_y WHERE q.id % 100 = 0"


def spatial_point(spark, sf):
    b = _boxes(spark, sf)
    q = b.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "min_x", "min_y", F.col("min_x").alias("max_x"), F.col("min_y").alias("max_y"))
    return S.box_join(b, q, 32.0)


SQL["spatial_point"] = f"WITH {_BOX} SELECT q.id AS query_id, b.id FROM box q JOIN box b ON q.min_x BETWEEN b.min_x AND b.max_x AND q.min_y BETWEEN b.min_y AND b.max_y WHERE q.id % 100 = 0"


def spatial_nearest(spark, sf):
    b = _boxes(spark, sf)
    q = b.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("max_x").alias("x"), F.col("min_y").alias("y"))
    return S.nearest_boxes(b, q, 5).withColumn("distance", F.round("distance", 6))


SQL["spatial_nearest"] = f"""WITH {_BOX}, d AS (SELECT q.id AS query_id, b.id, sqrt(pow((b.min_x + b.max_x) / 2 - q.max_x, 2) + pow((b.min_y + b.max_y) / 2 - q.min_y, 2)) AS d FROM box q JOIN box b ON TRUE WHERE q.id % 100 = 0),
r AS (SELECT query_id, id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 5"""


def spatial_bounds(spark, sf):
    return S.bounding_box(_boxes(spark, sf).withColumn("part", F.col("id") % 7), "part").withColumn("area", S.area({c: F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")}))


SQL["spatial_bounds"] = f"WITH {_BOX}, g AS (SELECT id % 7 AS part, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM box GROUP BY 1) SELECT *, (max_x - min_x) * (max_y - min_y) AS area FROM g"


def nonvector_hash(spark, sf):
    """The memories' content hash without vectors, blocks of ids first, then the blocks' hashes."""
    return I.block_fingerprint(W.memories(spark, sf), "id", ["id", "agent", "category", "content"], 100)


SQL["nonvector_hash"] = f"WITH {W.MEM}, b AS (SELECT id // 100 AS block, sha256(string_agg(sha256({W.row_sql('CAST(id AS VARCHAR)', 'agent', 'category', 'content')}), '' ORDER BY id)) AS h, count(*) AS n FROM mem GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY block)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM b"


def witness_chain_check(spark, sf):
    """Events of a user as checkpoints: some repeat or skip a number."""
    e = W.table(spark, sf, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    log = e.select(F.col("user_id").alias("stream"), "event_id", n.alias("seq0")).withColumn("sequence", F.when(F.col("seq0") % 37 == 0, F.col("seq0") + 1).otherwise(F.col("seq0")))
    log = log.select("stream", F.col("seq0").alias("at"), "sequence", F.sha2(F.concat_ws(":", "stream", "sequence"), 256).alias("digest"), F.when(F.col("sequence") == 1, "0" * 64).otherwise(F.sha2(F.concat_ws(":", "stream", F.col("sequence") - 1), 256)).alias("previous"))
    return I.witness_breaks(log).select("stream", F.col("at").cast("long").alias("at"), "problem")


SQL["witness_chain_check"] = """WITH e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT *, CASE WHEN i % 37 = 0 THEN i + 1 ELSE i END AS q FROM e),
l AS (SELECT *, lag(q) OVER (PARTITION BY stream ORDER BY i) AS p FROM s)
SELECT stream, i AS "at", 'sequence' AS problem FROM l WHERE q <> coalesce(p, 0) + 1"""


def migration_plan(spark, sf):
    m = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, F.lit(None)).otherwise(F.col("embedding")).alias("embedding"))
    return Q.plan(m, 64, 1024, 256)


SQL["migration_plan"] = """SELECT count(*) AS n_rows, count(*) FILTER (WHERE vec_id % 9 <> 0) AS n_vectors, 64 AS source_dimensions, 1024 AS target_dimensions, count(*) FILTER (WHERE vec_id % 9 <> 0 AND len(embedding) <> 64) AS n_unexpected, CAST(ceil(count(*) / 256.0) AS BIGINT) AS n_batches FROM embeddings"""


def lru_cache(spark, sf):
    log = W.table(spark, sf, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return S.lru_simulation(log, 40)


SQL["stream_activity_windows"] = "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01')) AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

for _f in (trie_prefix, trie_count_prefix, trie_autocomplete, fenwick_prefix_sum, fenwick_range_sum, fenwick_kth, spatial_range, spatial_point, spatial_nearest, spatial_bounds, nonvector_hash, witness_chain_check, migration_plan, lru_cache):
    QUERIES[_f.__name__] = _f
