"""Queries on embeddings, search, scores, lists and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as X
from ..operators import memory as M
from ..operators import vectors as V
from ..operators.vector_index import StoredIndex
from ..sources.scratch import shared_dir
from . import views as W

QUERIES, SQL = {}, {}


def tokenize_bigrams(spark, sf):
    return X.token_counts(W.memories(spark, sf), "id", "content")


SQL["tokenize_bigrams"] = f"""WITH {W.MEM}, {W.hash_sql('d', 'mem', 'id', 'content')}
SELECT key AS id, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct, min(t) AS first_token, max(t) AS last_token FROM d_t GROUP BY key"""


def hash_embedding(spark, sf):
    return X.hash_counts(W.memories(spark, sf), "id", "content").select("id", "bucket", F.col("n").cast("long").alias("n"))


SQL["hash_embedding"] = f"WITH {W.MEM}, {W.hash_sql('d', 'mem', 'id', 'content')} SELECT key AS id, bucket, n FROM d_c"


def temporal_decay_score(spark, sf):
    m = W.memories(spark, sf).withColumn("similarity", F.col("relevance_score"))
    return M.scored(m, W.as_of()).select("id", F.round("days_old", 6).alias("days_old"), F.round("score", 6).alias("score"))


HL = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.HALF_LIVES.items()) + " ELSE 30 END"
SCORE = """hl AS (SELECT *, (1782864000 - created_at) / 86400.0 AS days_old, CASE WHEN importance >= 10 THEN 99999 WHEN importance >= 8 THEN greatest(2 * base, 180) ELSE base END
         * CASE WHEN greatest(abs(valence), arousal) > 0.5 THEN 1 + least(greatest(abs(valence), arousal), 1) ELSE 1 END AS h FROM (SELECT *, CAST({hl} AS DOUBLE) AS base FROM {src})),
ranked AS (SELECT *, greatest((0.5 * similarity + 0.3 * utility_score + 0.2 * least(greatest(confidence_score, 0), 1)) * pow(0.5, days_old / h) * (0.5 + importance / 20.0),
         greatest(similarity, 0) * 0.8) + importance * 1e-6 AS score FROM hl)"""
SQL["temporal_decay_score"] = f"WITH {W.MEM}, src AS (SELECT *, relevance_score AS similarity FROM mem), {SCORE.format(hl=HL, src='src')} SELECT id, round(CAST(days_old AS DOUBLE), 6) AS days_old, round(score, 6) AS score FROM ranked"


def half_life_by_category(spark, sf):
    m = W.memories(spark, sf)
    h = scoring.effective_half_life(F.col("category"), F.col("importance"), F.col("valence"), F.col("arousal"))
    return m.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max(scoring.half_life(F.col("category"))).alias("base_days"), F.round(F.avg(h), 4).alias("mean_days"))


SQL["half_life_by_category"] = f"WITH {W.MEM}, src AS (SELECT *, 0.0 AS similarity FROM mem), {SCORE.format(hl=HL, src='src')} SELECT category, count(*) AS n, max(base) AS base_days, round(avg(h), 4) AS mean_days FROM ranked GROUP BY category"


def _search(spark, sf, **options):
    out = M.search(W.embedded(W.memories(spark, sf)), W.queries(spark, sf), W.as_of(), **options)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


def search_sql(where: str, pool: str, more: str = "", limit: int = 10) -> str:
    return f"""WITH {W.MEM}, {W.QUERIES_SQL}{more}, {W.hash_sql('d', 'mem', 'id', 'content')}, {W.hash_sql('q', 'qry', 'query_id', 'query')},
dots AS (SELECT q.key AS query_id, d.key AS id, CAST(sum(q.n * d.n) AS DOUBLE) AS dot FROM q_c q JOIN qry ON qry.query_id = q.key JOIN mem ON mem.agent = qry.agent JOIN d_c d ON d.key = mem.id AND d.bucket = q.bucket GROUP BY ALL),
pairs AS (SELECT mem.*, qry.query_id, qry.query, coalesce(dots.dot / (qn.norm * dn.norm), 0) AS similarity FROM mem JOIN qry ON mem.agent = qry.agent LEFT JOIN dots ON dots.query_id = qry.query_id AND dots.id = mem.id
  LEFT JOIN q_n qn ON qn.key = qry.query_id LEFT JOIN d_n dn ON dn.key = mem.id WHERE invalid_at IS NULL{where}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS nr FROM pairs), pool AS (SELECT * FROM near WHERE {pool}), {SCORE.format(hl=HL, src='pool')},
fin AS (SELECT query_id, id, round(similarity, 6) AS similarity, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ranked)
SELECT * FROM fin WHERE rank <= {limit}"""


LITERAL = "nr <= 100 OR (query <> '' AND contains(lower(content), lower(query)))"


def search_hybrid(spark, sf):
    return _search(spark, sf)


def search_filtered(spark, sf):
    return _search(spark, sf, min_importance=6, scope="private")


def search_literal_fallback(spark, sf):
    return _search(spark, sf, candidates=1)


SQL["search_hybrid"] = search_sql("", LITERAL)
SQL["search_filtered"] = search_sql(" AND importance >= 6 AND scope = 'private'", "TRUE")
SQL["search_literal_fallback"] = search_sql("", LITERAL.replace("100", "1", 1))


def search_context(spark, sf):
    """Each item is asked in the context of the conversation of the same number."""
    conv = W.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]).alias("lines"))
    q = W.asked(spark, sf).join(conv, F.col("query_id") == F.col("conv_id"), "left")
    q = q.withColumn("asked", X.contextualize(F.col("query"), F.coalesce("lines", F.array().cast("array<string>")), 2000))
    q = W.embedded(q, "query_id", "asked").withColumnRenamed("vec", "query_vec")
    out = M.search(W.embedded(W.memories(spark, sf)), q, W.as_of(), limit=5)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "rank")


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQL["search_context"] = search_sql("", LITERAL, f""", ln AS (SELECT conv_id, string_agg(s, chr(10) ORDER BY turn, role, text) AS c FROM (SELECT *, {_STRIP.format('text')} AS s FROM conversations) WHERE s <> '' GROUP BY conv_id),
ctx AS (SELECT conv_id, {_STRIP.format('c')} AS c FROM ln),
asked AS (SELECT query_id, CASE WHEN coalesce(c, '') = '' THEN {_STRIP.format('query')} ELSE right(c, 2000) || chr(10) || {_STRIP.format('query')} END AS asked FROM qry LEFT JOIN ctx ON conv_id = query_id)""", 5).replace(W.hash_sql("q", "qry", "query_id", "query"), W.hash_sql("q", "asked", "query_id", "asked"))


def _knn(spark, sf, on):
    v = W.vectors(spark, sf)
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "agent")
    out = V.knn(q, v, 10, on=on) if on else V.knn_matrix(q, v, 10)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_exact(spark, sf):
    return _knn(spark, sf, None)


def knn_filtered(spark, sf):
    return _knn(spark, sf, ["agent"])


_KNN = "WITH {vec}, p AS (SELECT q.id AS query_id, b.id, {cos} AS s FROM vec q JOIN vec b ON {on} WHERE q.id % 100 = 0), r AS (SELECT query_id, id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 10"
SQL["knn_exact"] = _KNN.format(vec=W.VEC, cos=W.COS.format(a="q.v", b="b.v"), on="TRUE")
SQL["knn_filtered"] = _KNN.format(vec=W.VEC, cos=W.COS.format(a="q.v", b="b.v"), on="q.agent = b.agent")


def knn_zero_union(spark, sf):
    v = W.vectors(spark, sf)
    q = v.filter("id % 100 = 0 or id % 100 = 7").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "agent")
    return M.nearest_with_zeros(v, q, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "no_signal", "rank")


SQL["knn_zero_union"] = f"""WITH {W.VEC}, z AS (SELECT *, list_sum(list_transform(v, lambda x: abs(x))) = 0 AS zero FROM vec),
p AS (SELECT q.id AS query_id, b.id, q.zero OR b.zero AS no_signal, {W.COS.format(a='q.v', b='b.v')} AS s FROM z q JOIN z b ON q.agent = b.agent WHERE q.id % 100 IN (0, 7)),
r AS (SELECT query_id, id, round(s, 6) AS similarity, no_signal, CAST(row_number() OVER (PARTITION BY query_id, no_signal ORDER BY s DESC, CASE WHEN no_signal THEN -id ELSE id END) AS INTEGER) AS rank FROM p) SELECT * FROM r WHERE rank <= 5"""


def memory_list_recent(spark, sf):
    return M.recent(W.memories(spark, sf), 20).select("agent", "id", "rank")


SQL["memory_list_recent"] = f"WITH {W.MEM}, r AS (SELECT agent, id, CAST(row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank FROM mem WHERE invalid_at IS NULL) SELECT * FROM r WHERE rank <= 20"


def memory_count(spark, sf):
    return M.counts(W.memories(spark, sf))


def memory_count_by_category(spark, sf):
    return M.counts(W.memories(spark, sf), "category")


SQL["memory_count"] = f"WITH {W.MEM} SELECT agent, count(*) AS n FROM mem WHERE invalid_at IS NULL GROUP BY agent"
SQL["memory_count_by_category"] = f"WITH {W.MEM} SELECT agent, category, count(*) AS n FROM mem WHERE invalid_at IS NULL GROUP BY agent, category"


def dimension_histogram(spark, sf):
    e = W.table(spark, sf, "embeddings")
    i = F.col("vec_id")
    return M.dimension_histogram(e.select(F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, F.slice("embedding", 1, 1)).otherwise(F.col("embedding")).alias("embedding")))


SQL["dimension_histogram"] = "SELECT CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 10 = 1 THEN 1 ELSE CAST(len(embedding) AS INTEGER) END AS dimensions, count(*) AS n FROM embeddings GROUP BY ALL"


def ann_lsh_recall(spark, sf):
    """Recall at 10 of the approximate index against the exact one, per engine."""
    v = W.vectors(spark, sf).filter(~V.is_zero(F.col("vec")))
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    exact = V.create_index("exact", 64).search(q, v, 10)
    found = V.create_index("lsh", 64).search(q, v.select("id", "vec"), 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def _index(spark, sf, rows) -> StoredIndex:
    return StoredIndex.build(rows.select("id", "vec"), f"{shared_dir(spark)}/index", X.DIMENSIONS)


def _corrected(spark, sf):
    """Memories whose corrections are embedded together with their category."""
    m = W.memories(spark, sf)
    return m.withColumn("content", F.when(F.col("category") == "correction", F.concat("category", F.lit(" "), "content")).otherwise(F.col("content")))


def index_search(spark, sf):
    """All memories are indexed, those no longer valid removed, corrections added again with other vectors; then the
    index is read again from its files and searched in all of its cells."""
    index = _index(spark, sf, W.embedded(W.memories(spark, sf)))
    index = index.remove(W.memories(spark, sf).filter(F.col("invalid_at").isNotNull()))
    new = W.embedded(M.live(_corrected(spark, sf)).filter("category = 'correction'"))
    index = StoredIndex.load(spark, index.add(new.select("id", "vec"), source="corrected").root, "corrected")
    q = W.embedded(W.memories(spark, sf).filter("id % 100 = 0")).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    out = index.search(q, 10, probes=StoredIndex.MOST_CELLS)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


SQL["index_search"] = f"""WITH {W.MEM}, now AS (SELECT id, CASE WHEN category = 'correction' THEN category || ' ' || content ELSE content END AS content FROM mem WHERE invalid_at IS NULL),
qry AS (SELECT id, content FROM mem WHERE id % 100 = 0), {W.hash_sql('d', 'now', 'id', 'content')}, {W.hash_sql('q', 'qry', 'id', 'content')},
dots AS (SELECT q.key AS query_id, d.key AS id, CAST(sum(q.n * d.n) AS DOUBLE) AS dot FROM q_c q JOIN d_c d ON d.bucket = q.bucket GROUP BY ALL),
pairs AS (SELECT qry.id AS query_id, now.id, round(coalesce(dot / (qn.norm * dn.norm), 0), 12) AS s FROM qry CROSS JOIN now LEFT JOIN dots ON dots.query_id = qry.id AND dots.id = now.id LEFT JOIN q_n qn ON qn.key = qry.id LEFT JOIN d_n dn ON dn.key = now.id),
r AS (SELECT query_id, id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INTEGER) AS rank FROM pairs) SELECT * FROM r WHERE rank <= 10"""


def index_recall(spark, sf):
    """Of each query the share of its ten nearest memories that the index finds, and of all rows that it reads for them."""
    m = W.embedded(W.memories(spark, sf))
    index = _index(spark, sf, m)
    q = m.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    hit = index.search(q, 10).select("query_id", "id", F.lit(1).alias("hit"))
    per = V.knn_matrix(q, m, 10).join(hit, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return per.join(index.reads(q), "query_id")


QUERIES |= {f.__name__: f for f in (index_search, index_recall, tokenize_bigrams, hash_embedding, temporal_decay_score, half_life_by_category, search_hybrid, search_filtered, search_context, search_literal_fallback, knn_exact, knn_filtered, knn_zero_union, memory_list_recent, memory_count, memory_count_by_category, dimension_histogram, ann_lsh_recall)}
