"""Queries that run the store, the facade's verbs, migration and checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..agent import Agent
from ..functions import text as X
from ..operators import agents as A
from ..operators import consolidation as C
from ..operators import graph as G
from ..operators import integrity as I
from ..operators import memory as M
from ..operators import structures as S
from ..operators import vectors as V
from ..sources import providers as P
from ..sources.scratch import Scratch, shared_dir
from ..sources.store import Conflict, Store
from . import shapes, upkeep
from . import views as W

QUERIES, SQL = {}, {}


def _stored(spark, sf, **options) -> Store:
    """All documents as memories in a new store."""
    store = Store(spark, shared_dir(spark), **options).initialize()
    store.append("memories", W.memories(spark, sf).drop("vec"))
    return store


def store_lifecycle(spark, sf):
    """Every memory after updates of one agent's and of all rows, a bulk update, invalidation, deletion and compaction."""
    s = _stored(spark, sf, compact_at=4)
    s.update("memories", F.col("id") % 7 == 0, {"importance": F.col("importance") + 10})
    s.update_from("memories", s.current("memories").filter("id % 5 = 0").select("id", (F.col("confidence_score") / 2).alias("confidence_score")))
    s.invalidate(list(range(0, 3000, 3)), W.as_of(), "src0")
    s.delete("memories", s.current("memories").filter("id % 13 = 0").select("id"))
    s.update("memories", (F.col("id") % 13 == 1) & (F.col("agent") == "src1"), {"category": F.lit("changed")})
    return s.current("memories").select("id", "agent", "category", "importance", F.round("confidence_score", 6).alias("confidence_score"), F.col("invalid_at").isNull().alias("live"), F.col("created_at").isNotNull().alias("timed"), "source", F.length("content").cast("long").alias("n"))


SQL["store_lifecycle"] = f"""WITH {W.MEM} SELECT id, agent, CASE WHEN id % 13 = 1 AND agent = 'src1' THEN 'changed' ELSE category END AS category, CAST(importance + CASE WHEN id % 7 = 0 THEN 10 ELSE 0 END AS INTEGER) AS importance,
round(CASE WHEN id % 5 = 0 THEN confidence_score / 2 ELSE confidence_score END, 6) AS confidence_score, invalid_at IS NULL AND NOT (agent = 'src0' AND id % 3 = 0 AND id < 3000) AS live, TRUE AS timed, 'conversation' AS source, CAST(length(content) AS BIGINT) AS n FROM mem WHERE id % 13 <> 0"""


def store_insert_ids(spark, sf):
    """The ids that two inserts of all conversation turns get, and of which insert they are."""
    s = Store(spark, shared_dir(spark)).initialize()
    rows = W.table(spark, sf, "conversations").select(F.col("role").alias("agent"), F.col("text").alias("thought"))
    out = [s.insert("inner_monologue", rows.withColumn("session_id", F.lit(str(i)))).select("id") for i in (1, 2)]
    return s.current("inner_monologue").select("id", F.col("session_id").cast("int").alias("batch")).join(out[0].unionByName(out[1]), "id")


SQL["store_insert_ids"] = "SELECT i AS id, CAST(CASE WHEN i <= (SELECT count(*) FROM conversations) THEN 1 ELSE 2 END AS INTEGER) AS batch FROM range(1, 2 * (SELECT count(*) FROM conversations) + 1) t(i)"


def store_two_writers(spark, sf):
    """Rows by agent after two writers of one table: a commit upon a state that is no longer the last one is refused."""
    a = _stored(spark, sf)
    b = Store(spark, a.root).initialize()
    rows = a.current("memories")
    seen = a._state("memories")[0]
    b.append("memories", rows.withColumn("id", F.col("id") + 10_000_000))
    try:
        a.append("memories", rows.withColumn("id", F.col("id") + 20_000_000), base=seen)
    except Conflict:
        a.append("memories", rows.withColumn("id", F.col("id") + 30_000_000))
    return b.current("memories").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


SQL["store_two_writers"] = f"WITH {W.MEM} SELECT agent, 3 * count(*) AS n, max(id) + 30000000 AS last FROM mem GROUP BY agent"


def memory_get(spark, sf):
    """Each benchmark item's number as an id asked of an agent: found only among its own, invalid ones too."""
    s = _stored(spark, sf)
    q = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("agent"))
    return s.current("memories").join(q, ["id", "agent"]).select("id", "agent", F.col("invalid_at").isNull().alias("live"))


SQL["memory_get"] = f"WITH {W.MEM} SELECT id, agent, invalid_at IS NULL AS live FROM mem JOIN benchmark ON id = item_id AND agent = 'src' || CAST(item_id % 20 AS VARCHAR)"


def memory_list_all(spark, sf):
    return M.recent(W.memories(spark, sf), 5, include_invalid=True).select("agent", "id", F.col("invalid_at").isNull().alias("live"), "rank")


SQL["memory_list_all"] = f"WITH {W.MEM}, r AS (SELECT agent, id, invalid_at IS NULL AS live, CAST(row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank FROM mem) SELECT * FROM r WHERE rank <= 5"


def search_like(spark, sf):
    """Each item's first word, with a wildcard in place of its second letter."""
    w = F.substring_index("text", " ", 1)
    q = W.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("agent"), F.concat(F.substring(w, 1, 1), F.lit("_"), F.substring(w, 3, 100)).alias("query"))
    return M.like_matches(W.memories(spark, sf), q)


SQL["search_like"] = f"""WITH {W.MEM}, w AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS agent, string_split(text, ' ')[1] AS w FROM benchmark), q AS (SELECT query_id, agent, substr(w, 1, 1) || '_' || substr(w, 3, 100) AS p FROM w)
SELECT query_id, id FROM mem JOIN q USING (agent) WHERE invalid_at IS NULL AND content ILIKE '%' || p || '%'"""


def contract_breaks(spark, sf):
    """Rows of a copy of the memories that break the table's rules: some ids repeat, some agents are missing."""
    m = W.memories(spark, sf).withColumn("id", F.when(F.col("id") % 10 == 3, F.col("id") - 1).otherwise(F.col("id"))).withColumn("agent", F.when(F.col("id") % 9 != 0, F.col("agent")))
    m = m.join(W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 8 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")).alias("embedding")), "id", "left")
    return schema.contract_breaks(m, "memories", 64)


SQL["contract_breaks"] = f"""WITH {W.MEM}, m AS (SELECT *, CASE WHEN id % 10 = 3 THEN id - 1 ELSE id END AS k FROM mem), d AS (SELECT k, count(*) AS n FROM m GROUP BY k HAVING n > 1),
x AS (SELECT 'null' AS problem, 'agent' AS "column", count(*) AS n FROM m WHERE k % 9 = 0 UNION ALL SELECT 'repeated key', 'id', CAST(coalesce(sum(n), 0) AS BIGINT) FROM d
UNION ALL SELECT 'dimensions', 'embedding', count(*) FROM m JOIN embeddings ON vec_id = k WHERE vec_id % 8 = 0) SELECT * FROM x WHERE n > 0"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
_KIND = "CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE 'other' END"


def schema_catalog(spark, sf):
    """Columns of all tables: their places and types."""
    out = None
    for t in _TABLES:
        one = schema.schema_rows(spark, W.table(spark, sf, t).schema).select(F.lit(t).alias("table"), F.col("ordinal") + 1, "column", "type").toDF("table", "ordinal", "column", "type")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("type", F.when(F.col("type").isin(list(_TYPES.values())), F.col("type")).otherwise("other"))


SQL["schema_catalog"] = f"""SELECT table_name AS "table", CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS "column", {_KIND} AS type FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in _TABLES)})"""


def schema_contract_diff(spark, sf):
    """How each table differs from that of the customers: columns that are missing, and those that are not expected."""
    want, out = W.table(spark, sf, "customer").schema, None
    for t in _TABLES:
        one = schema.contract_diff(spark, W.table(spark, sf, t).schema, want).select(F.lit(t).alias("table"), "problem", "column")
        out = one if out is None else out.unionByName(one)
    return out


SQL["schema_contract_diff"] = f"""WITH c AS (SELECT table_name AS t, column_name AS "column", data_type AS d FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in _TABLES)})), w AS (SELECT "column", d FROM c WHERE t = 'customer'), n AS (SELECT DISTINCT t FROM c)
SELECT n.t AS "table", 'missing' AS problem, w."column" FROM n CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.t = n.t AND c."column" = w."column" AND c.d = w.d)
UNION ALL SELECT c.t, 'unexpected', c."column" FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE c."column" = w."column" AND c.d = w.d)"""


def key_sets(spark, sf):
    """Ids that only documents or only labels have."""
    d, n = W.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), W.table(spark, sf, "labels").select((F.col("doc_id") + F.col("toxic") * 1_000_000_000).alias("id"))
    return I.key_difference(d, n, "id")


SQL["key_sets"] = "WITH l AS (SELECT DISTINCT doc_id + toxic * 1000000000 AS id FROM labels) SELECT 'left' AS side, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT id FROM l) UNION ALL SELECT 'right', id FROM l WHERE id NOT IN (SELECT doc_id FROM documents)"


def vector_guards(spark, sf):
    """Of every vector, some made faulty: whether its size is right, it is finite, zero, and what its blob round trip gives."""
    i = F.col("vec_id")
    v = F.when(i % 11 == 0, F.slice("embedding", 1, 7)).when(i % 11 == 1, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(i % 11 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")).cast("array<float>")
    e = W.table(spark, sf, "embeddings").select(i.alias("id"), v.alias("v"))
    e = e.withColumn("b", P.pack_vectors(F.col("v"))).withColumn("back", P.unpack_vectors(F.col("b")))
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return e.select("id", (F.size("v") == 64).alias("sized"), finite.alias("finite"), V.is_zero(F.col("v")).alias("zero"), F.octet_length("b").cast("long").alias("n_bytes"), F.when(finite, F.round(total, 4)).alias("total"))


SQL["vector_guards"] = """WITH e AS (SELECT vec_id AS id, CASE vec_id % 11 WHEN 0 THEN embedding[1:7] WHEN 1 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) WHEN 2 THEN list_transform(embedding, lambda x: CAST('NaN' AS FLOAT)) ELSE embedding END AS v FROM embeddings)
SELECT id, len(v) = 64 AS sized, id % 11 <> 2 AS finite, id % 11 = 1 AS zero, CAST(4 * len(v) AS BIGINT) AS n_bytes, CASE WHEN id % 11 <> 2 THEN round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))), 4) END AS total FROM e"""


def secrets_and_slugs(spark, sf):
    """Of every page: its address as a name for a path, and whether its text holds a key of a service."""
    p = W.table(spark, sf, "pages")
    return p.select("page_id", X.slug(F.col("url")).alias("slug"), X.has_secret(F.col("html")).alias("secret"))


SQL["secrets_and_slugs"] = r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, html FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'agent' ELSE s END AS slug, regexp_matches(html, 'gsk_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}') AS secret FROM s"""


def row_defaults(spark, sf):
    """Events as memories that leave most out: defaults, and {} for properties that are not JSON."""
    e = W.table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("agent"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 10).cast("int")).alias("importance"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")).alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"))
    return schema.with_defaults(rows, "memories").select("id", "category", "importance", "scope", "confidence_score", "utility_score", "relevance_score", "identity_defining", F.md5("metadata").alias("metadata_md5"))


SQL["row_defaults"] = "SELECT event_id AS id, 'fact' AS category, CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 10 ELSE 5 END AS INTEGER) AS importance, 'private' AS scope, CAST(1 AS DOUBLE) AS confidence_score, CAST(0.5 AS DOUBLE) AS utility_score, CAST(1 AS DOUBLE) AS relevance_score, FALSE AS identity_defining, md5(CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END) AS metadata_md5 FROM events"


def ocean_valid(spark, sf):
    c = W.table(spark, sf, "customer")
    k = F.col("c_custkey")
    scores = F.map_from_arrays(F.array(F.lit("O"), F.lit("N")), F.array((k * 7) % 120 / F.lit(100.0), (k * 13) % 120 / F.lit(100.0) - 0.1))
    return c.select(k.alias("agent"), A.valid_ocean(F.when(k % 5 == 0, F.create_map().cast("map<string,double>")).otherwise(scores)).alias("valid"))


SQL["ocean_valid"] = "SELECT c_custkey AS agent, c_custkey % 5 = 0 OR ((c_custkey * 7) % 120 <= 100 AND (c_custkey * 13) % 120 BETWEEN 10 AND 110) AS valid FROM customer"


def clamped_similarity(spark, sf):
    e = W.table(spark, sf, "events")
    return e.select("event_id", F.round(V.clamp_similarity(F.col("event_id") % 50 / F.lit(16.0)), 6).alias("similarity"))


SQL["clamped_similarity"] = "SELECT event_id, round(least(greatest(1 - CAST(event_id % 50 AS DOUBLE) / 16, -1), 1), 6) AS similarity FROM events"


# Consolidation: the merge is replayed in SQL pair by pair.
_MERGE = f"""{upkeep.PAIRS_SQL}, mp AS (SELECT p.agent, a, b, row_number() OVER (PARTITION BY p.agent ORDER BY a, b) AS rn, x.importance AS ia, y.importance AS ib, CASE WHEN x.relevance_score = 0 THEN 1.0 ELSE x.relevance_score END AS ra, CASE WHEN y.relevance_score = 0 THEN 1.0 ELSE y.relevance_score END AS rb
  FROM pairs p JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE similarity >= 0.92),
st(agent, rn, lost, cur, skip, win, lose, rel) AS (SELECT DISTINCT agent, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), FALSE, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM mp
  UNION ALL SELECT agent, rn, CASE WHEN act THEN list_append(lost, CASE WHEN bb THEN a ELSE b END) ELSE lost END, a, skip, CASE WHEN act THEN CASE WHEN bb THEN b ELSE a END END, CASE WHEN act THEN CASE WHEN bb THEN a ELSE b END END, CASE WHEN bb THEN rb ELSE ra END
  FROM (SELECT *, NOT skip AND NOT list_contains(lost, b) AS act FROM (SELECT st.agent, mp.rn, st.lost, mp.a, mp.b, ra, rb, ib > ia OR (ib = ia AND rb > ra) AS bb, CASE WHEN mp.a <> st.cur THEN list_contains(st.lost, mp.a) ELSE st.skip END AS skip FROM st JOIN mp ON mp.agent = st.agent AND mp.rn = st.rn + 1))),
won AS (SELECT agent, win AS id, count(*) AS merges, max(least(1.0, rel + 0.05)) AS relevance_score FROM st WHERE win IS NOT NULL GROUP BY agent, win), gone AS (SELECT DISTINCT agent, lose AS id FROM st WHERE lose IS NOT NULL)"""
SQL["sleep_consolidate"] = f"WITH RECURSIVE {_MERGE} SELECT coalesce(w.agent, g.agent) AS agent, coalesce(w.id, g.id) AS id, g.id IS NOT NULL AS invalidated, round(w.relevance_score, 6) AS relevance_score, coalesce(merges, 0) AS merges FROM won w FULL JOIN gone g ON g.agent = w.agent AND g.id = w.id"


def sleep_report(spark, sf):
    """What each phase would touch, by agent, on the unchanged input."""
    return C.run_phases(W.embedded(W.memories(spark, sf)), W.as_of())[1]


_PRUNED = "pr AS (SELECT agent, row_number() OVER (PARTITION BY agent ORDER BY relevance_score, id) AS n FROM mem WHERE invalid_at IS NULL AND relevance_score < 0.05 AND importance <= 5 AND NOT identity_defining)"
_REPORT = f"""{_MERGE}, {_PRUNED}, rep AS (SELECT agent, 'replay' AS phase, count(*) FILTER (WHERE invalid_at IS NULL AND last_activation > 1782864000 - 86400) AS affected FROM mem GROUP BY agent
UNION ALL SELECT agent, 'forget', count(*) FILTER (WHERE {upkeep._STALE}) FROM mem GROUP BY agent
UNION ALL SELECT m.agent, 'prune', (SELECT count(*) FROM pr WHERE pr.agent = m.agent AND n <= 50) FROM (SELECT DISTINCT agent FROM mem) m
UNION ALL SELECT m.agent, 'consolidate', coalesce((SELECT CAST(sum(merges) AS BIGINT) FROM won WHERE won.agent = m.agent), 0) FROM (SELECT DISTINCT agent FROM mem) m)"""
SQL["sleep_report"] = f"WITH RECURSIVE {_REPORT} SELECT * FROM rep"


def sleep_summary(spark, sf):
    return C.report_summary(sleep_report(spark, sf))


SQL["sleep_summary"] = f"""WITH RECURSIVE {_REPORT} SELECT agent, 'Sleep Gate [DRY-RUN] — ' || agent || chr(10) || string_agg('  ' || upper(phase) || ': ' || affected || ' affected', chr(10) ORDER BY list_position(['replay', 'forget', 'prune', 'consolidate'], phase)) || chr(10) || '  Total: ' || CAST(sum(affected) AS BIGINT) AS summary FROM rep GROUP BY agent"""


def sleep_live(spark, sf):
    """The memories after all phases, each of which saw what the one before wrote; what merging does is in `sleep_consolidate`."""
    m, t = W.memories(spark, sf), W.as_of()
    for f in (C.replay, C.forget, C.prune):
        m = f(m, t).drop("affected")
    return m.select("id", F.round("relevance_score", 6).alias("relevance_score"), F.round("utility_score", 6).alias("utility_score"), F.col("invalid_at").isNull().alias("live"))


_LIVE1 = f"p1 AS (SELECT *, CASE WHEN invalid_at IS NULL AND last_activation > 1782864000 - 86400 THEN least(1.0, {upkeep._DEF} + 0.1) ELSE relevance_score END AS r1 FROM mem)"
_FADED = "(CASE WHEN r1 = 0 THEN 1.0 ELSE r1 END) * (1 - (1 - 0.85) / (1 + 0.5 * abs(valence) + 0.3 * arousal))"
SQL["sleep_live"] = f"""WITH {W.MEM}, {_LIVE1}, p2 AS (SELECT *, CASE WHEN {upkeep._STALE} THEN {_FADED} ELSE r1 END AS r2, CASE WHEN {upkeep._STALE} THEN greatest(0.0, CASE WHEN utility_score = 0 THEN 0.5 ELSE utility_score END - 0.03) ELSE utility_score END AS u2 FROM p1),
p3 AS (SELECT *, invalid_at IS NULL AND r2 < 0.05 AND importance <= 5 AND NOT identity_defining AS can FROM p2), p4 AS (SELECT *, row_number() OVER (PARTITION BY agent, can ORDER BY r2, id) AS n FROM p3)
SELECT id, round(r2, 6) AS relevance_score, round(u2, 6) AS utility_score, invalid_at IS NULL AND NOT (can AND n <= 50) AS live FROM p4"""


def graph_stats(spark, sf):
    """Nodes, edges and entities of each agent's graph, and the line that reports them."""
    m = W.embedded(W.memories(spark, sf))
    c = G.graph_totals(m, G.edge_counts(m), G.mentions(m))
    line = F.concat(F.lit("Connectome [DRY-RUN] — "), "agent", F.lit(": "), F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("edges").cast("string"), F.lit(" edges, "), F.col("entities").cast("string"), F.lit(" entities"))
    return c.select("agent", "nodes", "edges", "entities", line.alias("summary"))


SQL["graph_stats"] = f"""WITH {upkeep.PAIRS_SQL}, bi AS (SELECT agent, a FROM pairs WHERE similarity >= 0.7 UNION ALL SELECT agent, b FROM pairs WHERE similarity >= 0.7), ed AS (SELECT agent, CAST(sum(least(n, 20)) AS BIGINT) AS edges FROM (SELECT agent, a, count(*) AS n FROM bi GROUP BY agent, a) GROUP BY agent),
{upkeep._ENT.removeprefix(W.MEM + ', ')}, en AS (SELECT agent, count(DISTINCT entity) AS entities FROM mentions GROUP BY agent), nn AS (SELECT agent, count(*) AS nodes FROM mem WHERE invalid_at IS NULL GROUP BY agent),
j AS (SELECT agent, nodes, coalesce(edges, 0) AS edges, coalesce(entities, 0) AS entities FROM nn LEFT JOIN ed USING (agent) LEFT JOIN en USING (agent))
SELECT *, 'Connectome [DRY-RUN] — ' || agent || ': ' || nodes || ' nodes, ' || edges || ' edges, ' || entities || ' entities' AS summary FROM j"""


# The facade: every region is one entry of an agent's tables.
def _agent(spark, name: str = "Ada") -> Agent:
    return Agent(spark, name, shared_dir(spark))


def _regions(spark, sf) -> list:
    return W.table(spark, sf, "region").orderBy("r_regionkey").collect()  # five rows whatever the scale


def agent_memories(spark, sf):
    """Two agents of one store that remember, change and forget: neither touches the other's memories."""
    ada = _agent(spark)
    bob = Agent(spark, "Bob", ada.store.root)
    text = W.table(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("content"))
    own, other = ada.remember(text, importance=7), bob.remember(text)
    ada.forget(own[0])
    ada.forget(other[1])
    bob.forget(own[2])
    ada.update(own[3], importance=9, category="decision")
    bob.update(own[4], importance=1)
    both = ada.list(100, include_invalid=True).unionByName(bob.list(100, include_invalid=True))
    return both.select("agent", "content", "category", "importance", F.col("invalid_at").isNull().alias("live"), F.size("embedding").alias("dimensions"))


SQL["agent_memories"] = """WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT 'Ada' AS agent, n_name AS content, CASE WHEN i = 3 THEN 'decision' ELSE 'fact' END AS category, CAST(CASE WHEN i = 3 THEN 9 ELSE 7 END AS INTEGER) AS importance, i <> 0 AS live, CAST(128 AS INTEGER) AS dimensions FROM n
UNION ALL SELECT 'Bob', n_name, 'fact', 5, TRUE, 128 FROM n"""


def agent_rules(spark, sf):
    """Rules that are set, set again, and deactivated."""
    r = _agent(spark).rules
    for row in _regions(spark, sf):
        r.set(row.r_name, row.r_comment if "r_comment" in row else row.r_name, "critical" if row.r_regionkey % 2 else "normal")
    for row in _regions(spark, sf):
        if row.r_regionkey == 1:
            r.set(row.r_name, "again", "high")
        if row.r_regionkey == 2:
            r.deactivate(row.r_name)
    return r.rows().select("rule_key", "priority", "active", F.when(F.col("content") == "again", "again").otherwise("first").alias("content"))


SQL["agent_rules"] = "SELECT r_name AS rule_key, CASE WHEN r_regionkey = 1 THEN 'high' WHEN r_regionkey % 2 = 1 THEN 'critical' ELSE 'normal' END AS priority, r_regionkey <> 2 AS active, CASE WHEN r_regionkey = 1 THEN 'again' ELSE 'first' END AS content FROM region"


def agent_instincts(spark, sf):
    """Instincts that are created, activated and deleted."""
    ins = _agent(spark).instincts
    for row in _regions(spark, sf):
        i = ins.create(row.r_name, "act", 0.2 * row.r_regionkey)
        if row.r_regionkey == 4:
            ins.delete(i)
        elif row.r_regionkey % 2:
            ins.activate(i, row.r_regionkey)
    return ins.list().select("trigger_pattern", "confidence", F.col("activation_count").cast("long").alias("activation_count"), F.col("last_activated").isNotNull().alias("used"), "rank")


SQL["agent_instincts"] = """WITH i AS (SELECT r_name AS trigger_pattern, CASE WHEN r_regionkey % 2 = 1 THEN round(1 - (1 - 0.2 * r_regionkey) * pow(0.9, r_regionkey), 4) ELSE CAST(0.2 * r_regionkey AS DOUBLE) END AS confidence, CASE WHEN r_regionkey % 2 = 1 THEN CAST(r_regionkey AS BIGINT) ELSE 0 END AS activation_count, r_regionkey % 2 = 1 AS used FROM region WHERE r_regionkey <> 4)
SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC) AS INTEGER) AS rank FROM i"""


def agent_identity(spark, sf):
    """Identity set in parts, scores moved, relationships set twice."""
    me = _agent(spark).identity
    me.set(personality="Curious")
    me.set_ocean({"O": 0.98, "C": 0.5, "N": 0.01})
    me.set(philosophy="All flows")
    new = me.drift({"O": 0.2, "C": -0.03, "N": -0.2, "E": 0.01})
    for row in _regions(spark, sf):
        me.relate(row.r_name, 0.1 * row.r_regionkey, "warm")
    for row in _regions(spark, sf):
        if row.r_regionkey == 0:
            me.relate(row.r_name, 0.9)
    i = me.get()
    line = f"{i.personality}/{i.philosophy}/" + ",".join(f"{k}={new[k]:.4f}" for k in "OCEAN")
    return me.relationships().select("person", F.round("trust_level", 6).alias("trust_level"), "style", "rank", F.lit(line).alias("identity"))


SQL["agent_identity"] = """WITH r AS (SELECT r_name AS person, CASE WHEN r_regionkey = 0 THEN 0.9 ELSE round(0.1 * r_regionkey, 6) END AS trust_level, CASE WHEN r_regionkey = 0 THEN 'default' ELSE 'warm' END AS style FROM region)
SELECT person, CAST(trust_level AS DOUBLE) AS trust_level, style, CAST(row_number() OVER (ORDER BY trust_level DESC, person) AS INTEGER) AS rank, 'Curious/All flows/O=1.0000,C=0.4700,E=0.5100,A=0.5000,N=0.0000' AS identity FROM r"""


def agent_reflections(spark, sf):
    """Thoughts by session and diary entries: the newest of each."""
    r = _agent(spark).reflections
    for row in _regions(spark, sf):
        r.add(row.r_name, "calm", session_id=str(row.r_regionkey % 2), turn_number=row.r_regionkey)
        r.write_diary(f"day {row.r_regionkey}", "fine", f"2025-01-0{row.r_regionkey + 1}")
    last, day = r.last(), r.last_diary()
    return r.list(2, "1").select("thought", "turn_number", "rank", F.lit(last.thought).alias("last_thought"), F.lit(str(day.session_date)).alias("last_day"))


SQL["agent_reflections"] = """SELECT r_name AS thought, CAST(r_regionkey AS INTEGER) AS turn_number, CAST(row_number() OVER (ORDER BY r_regionkey DESC) AS INTEGER) AS rank, (SELECT arg_max(r_name, r_regionkey) FROM region) AS last_thought, '2025-01-0' || CAST((SELECT max(r_regionkey) + 1 FROM region) AS VARCHAR) AS last_day FROM region WHERE r_regionkey % 2 = 1 QUALIFY rank <= 2"""


def agent_procedures(spark, sf):
    """Procedures that are stored, found (which counts a hit), judged and reflected on."""
    p = _agent(spark).procedures
    ids = {}
    for row in _regions(spark, sf):
        ids[row.r_regionkey] = p.add(row.r_name, "step one", "build" if row.r_regionkey % 2 else "general", success=row.r_regionkey != 3)
    p.search("A", 5, "build")
    p.record_outcome(ids[0], True)
    p.record_outcome(ids[0], False)
    p.add_reflection(ids[2], "slow")
    one, n = p.success_rate(ids[0]), p.count("build")
    return p.rows().select("task_description", "task_type", *[F.col(f"{k}_count").cast("long").alias(f"{k}_count") for k in ("hit", "success", "fail")], F.coalesce("reflection", F.lit("")).alias("reflection"), F.size("embedding").alias("dimensions"), F.round(F.lit(one), 6).alias("rate_of_first"), F.lit(n).cast("long").alias("n_build"))


SQL["agent_procedures"] = """SELECT r_name AS task_description, CASE WHEN r_regionkey % 2 = 1 THEN 'build' ELSE 'general' END AS task_type, CASE WHEN r_regionkey % 2 = 1 THEN CAST(1 AS BIGINT) ELSE 0 END AS hit_count,
CASE r_regionkey WHEN 0 THEN CAST(2 AS BIGINT) WHEN 3 THEN 0 ELSE 1 END AS success_count, CASE WHEN r_regionkey IN (0, 3) THEN CAST(1 AS BIGINT) ELSE 0 END AS fail_count, CASE WHEN r_regionkey = 2 THEN 'slow' ELSE '' END AS reflection, CAST(128 AS INTEGER) AS dimensions, round(2.0 / 3, 6) AS rate_of_first, (SELECT count(*) FROM region WHERE r_regionkey % 2 = 1) AS n_build FROM region"""


def integrity_seals(spark, sf):
    """Each agent's memories sealed, and one's then changed behind the seal's back: who is still served."""
    s = _stored(spark, sf)
    signer = I.TrustStore({"a": I.HmacSigner(b"one"), "b": I.HmacSigner(b"two")}, "b")
    witness, cols = I.StoredWitness(spark, f"{s.root}/_witness"), ["id", "content", "importance"]
    names = sorted(r.agent for r in s.current("memories").select("agent").distinct().collect())
    rows, out = s.current("memories"), []
    changed = rows.withColumn("importance", F.when((F.col("agent") == names[0]), F.col("importance") + 1).otherwise(F.col("importance")))
    for n in names:
        I.Guard(n, n, signer, witness, cols).seal(rows)
        g = I.Guard(n, n, signer, witness, cols)  # another driver, which finds the checkpoint
        c = g.checkpoint
        try:
            out.append((n, c.sequence, g.verified(changed).count()))
        except I.IntegrityError:
            out.append((n, c.sequence, -1))
    return spark.createDataFrame(out, "agent string, sequence int, served long")


SQL["integrity_seals"] = f"WITH {W.MEM}, a AS (SELECT agent, count(*) AS n, row_number() OVER (ORDER BY agent) AS i FROM mem GROUP BY agent) SELECT agent, CAST(1 AS INTEGER) AS sequence, CASE WHEN i = 1 THEN -1 ELSE n END AS served FROM a"


def migration_reembed(spark, sf):
    """Memories embedded anew at 256 dimensions by a run that stops, goes on and is verified: set buckets and sum of each vector."""
    from ..operators import migration as Q

    root = shared_dir(spark)
    src, cand, mark = (f"{root}/{x}" for x in ("source", "candidate", "mark.json"))
    W.memories(spark, sf).withColumn("embedding", F.array_repeat(F.lit(0.25).cast("float"), 128)).write.parquet(src)
    embed = lambda df: X.hash_embed(df, "id", "_text", "c", 256).select("id", F.col("c").cast("array<float>").alias("embedding"))
    Q.migrate(spark, src, cand, mark, embed, target=256, ranges=3, max_ranges=1)
    state = Q.migrate(spark, src, cand, mark, embed, target=256, ranges=3, resume=True)
    done = Q.rollback(spark, mark)["status"]
    out = spark.read.parquet(*[f"{cand}/range={i}" for i in range(3)])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("long")
    return out.select("id", "agent", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_set"), total.alias("total"), F.lit(f"{state['status']}, {done}").alias("status"))


SQL["migration_reembed"] = f"WITH {W.MEM}, {W.hash_sql('d', 'mem', 'id', 'content').replace('% 128', '% 256')}, c AS (SELECT key, count(*) AS n_set, CAST(sum(n) AS BIGINT) AS total FROM d_c GROUP BY key) SELECT id, agent, coalesce(n_set, 0) AS n_set, coalesce(total, 0) AS total, 'complete, rolled_back' AS status FROM mem LEFT JOIN c ON key = id"


# Trees over the documents.
def _leaves(spark, sf) -> DataFrame:
    d = W.table(spark, sf, "documents")
    return d.select(F.col("source").alias("tree"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("idx"), F.sha2("text", 256).alias("hash"))


_LEVELS = """lv(tree, level, idx, hash, n) AS (SELECT source, 0, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1, sha256(text), count(*) OVER (PARTITION BY source) FROM documents
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(hash || coalesce(right_, hash)), (n + 1) // 2 FROM (SELECT *, lead(hash) OVER (PARTITION BY tree ORDER BY idx) AS right_ FROM lv) WHERE n > 1 AND idx % 2 = 0)"""


def merkle_root(spark, sf):
    return S.merkle_root(_leaves(spark, sf), "tree")


SQL["merkle_root"] = f"WITH RECURSIVE {_LEVELS} SELECT tree, hash AS root FROM lv WHERE n = 1"


def merkle_proof(spark, sf):
    """Every leaf's path: the sibling at each level and its side."""
    p = S.merkle_proof(_leaves(spark, sf), "tree")
    return p.select("tree", F.col("leaf").cast("long").alias("leaf"), F.col("level").cast("int").alias("level"), "sibling", "side")


SQL["merkle_proof"] = f"""WITH RECURSIVE {_LEVELS}, leaf AS (SELECT tree, idx AS leaf FROM lv WHERE level = 0)
SELECT leaf.tree, leaf.leaf, o.level, coalesce(s.hash, o.hash) AS sibling, CASE WHEN s.hash IS NULL OR o.idx % 2 = 0 THEN 'right' ELSE 'left' END AS side
FROM leaf JOIN lv o ON o.tree = leaf.tree AND o.n > 1 AND o.idx = leaf.leaf >> o.level LEFT JOIN lv s ON s.tree = o.tree AND s.level = o.level AND s.idx = xor(o.idx, 1)"""


def hash_chain_head(spark, sf):
    """A chain of each user's events."""
    e = W.table(spark, sf, "events")
    row = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    return S.chain_head(e, "user_id", "event_id", row, F.sha2(F.lit("chain"), 256)).withColumnRenamed("user_id", "agent")


SQL["hash_chain_head"] = """WITH h AS (SELECT user_id AS agent, list(sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type)) ORDER BY event_id) AS l FROM events GROUP BY 1)
SELECT agent, list_reduce(list_concat([sha256('chain')], l), lambda a, x: sha256(a || x)) AS head, len(l) AS n FROM h"""


def rows_fingerprint(spark, sf):
    return I.block_fingerprint(W.table(spark, sf, "customer"), "c_custkey", ["c_custkey", "c_name"], 1000)


SQL["rows_fingerprint"] = f"""WITH h AS (SELECT c_custkey // 1000 AS b, sha256(string_agg(sha256({W.row_sql('CAST(c_custkey AS VARCHAR)', 'c_name')}), '' ORDER BY c_custkey)) AS h, count(*) AS n FROM customer GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM h"""

SQL["lru_cache"] = """WITH e AS (SELECT event_type AS cache, event_id AS i, user_id AS k, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS p FROM events),
h AS (SELECT cache, i, p IS NOT NULL AND (SELECT count(DISTINCT x.k) FROM e x WHERE x.cache = e.cache AND x.i > e.p AND x.i < e.i) < 40 AS hit FROM e), c AS (SELECT cache, count(DISTINCT k) AS d FROM e GROUP BY cache),
s AS (SELECT cache, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM h GROUP BY cache)
SELECT cache, hits, misses, misses - least(d, 40) AS evictions, CAST(hits AS DOUBLE) / greatest(1, hits + misses) AS hit_rate FROM s JOIN c USING (cache)"""


def trie_has_key(spark, sf):
    k = W.table(spark, sf, "part").select(F.col("p_name").alias("key"))
    probes = k.select(F.explode(F.array("key", F.substring("key", 1, 5), F.lit(""))).alias("probe"))
    return S.has_key(k, probes)


SQL["trie_has_key"] = "WITH p AS (SELECT DISTINCT unnest([p_name, substr(p_name, 1, 5), '']) AS probe FROM part) SELECT probe, probe IN (SELECT p_name FROM part) AS found FROM p"


def fenwick_point_query(spark, sf):
    return S.point_values(shapes._points(spark, sf), spark.range(-5, 4000, 3).select(F.col("id").alias("idx")), 3500)


SQL["fenwick_point_query"] = f"WITH {shapes._PTS} SELECT i AS idx, (SELECT count(*) FROM pts WHERE idx = i) AS total FROM range(-5, 4000, 3) t(i) WHERE i BETWEEN 1 AND 3500"


def spatial_predicates(spark, sf):
    """Each box against that of the next number."""
    b = shapes._boxes(spark, sf)
    names = ("min_x", "min_y", "max_x", "max_y")
    j = b.join(b.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"q_{c}") for c in names]), "id")
    x, y = S._box(""), S._box("q_")
    wide = {c: v - 40 if c.startswith("min") else v + 40 for c, v in x.items()}
    return j.select("id", S.expansion(x, y).alias("expansion"), S.intersects(wide, y).alias("meets"), S.contains(wide, y).alias("holds"), S.contains_point(wide, F.col("q_min_x"), F.col("q_max_y")).alias("holds_corner"))


SQL["spatial_predicates"] = f"""WITH {shapes._BOX}, j AS (SELECT a.id, a.min_x, a.min_y, a.max_x, a.max_y, b.min_x AS x0, b.min_y AS y0, b.max_x AS x1, b.max_y AS y1 FROM box a JOIN box b ON b.id = a.id + 1)
SELECT id, (greatest(max_x, x1) - least(min_x, x0)) * (greatest(max_y, y1) - least(min_y, y0)) - (max_x - min_x) * (max_y - min_y) AS expansion,
min_x - 40 <= x1 AND max_x + 40 >= x0 AND min_y - 40 <= y1 AND max_y + 40 >= y0 AS meets, min_x - 40 <= x0 AND min_y - 40 <= y0 AND max_x + 40 >= x1 AND max_y + 40 >= y1 AS holds, x0 BETWEEN min_x - 40 AND max_x + 40 AND y1 BETWEEN min_y - 40 AND max_y + 40 AS holds_corner FROM j"""


def stream_activity_windows(spark, sf):
    """The stream of events with a watermark, read to its end batch by batch: tumbling counts."""
    from ..streaming import activity

    root = shared_dir(spark)
    events = W.table(spark, sf, "events")
    out = activity.windowed(activity.read_events(spark, f"{sf}/events.parquet*", events.schema))
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/windows")
    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/windows")


def stream_into_store(spark, sf):
    """Events as thoughts, streamed into the store; the last micro-batch is then given again, as after a failure, and an
    older one too. What each agent has in the end."""
    from ..streaming import activity

    root = shared_dir(spark)
    store = Store(spark, f"{root}/store").initialize()
    events = W.table(spark, sf, "events")
    rows = activity.read_events(spark, f"{sf}/events.parquet*", events.schema).select(F.col("event_id").alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("agent"), F.col("event_type").alias("thought"), F.col("ts").alias("created_at"))
    sink, seen = activity.store_sink(store, "inner_monologue", "events"), []

    def apply(batch, number):
        sink(batch, number)
        sink(batch.withColumn("id", F.col("id") + 10_000_000_000), number)
        seen.append(number)

    activity.apply_batches(rows, apply, f"{root}/progress").awaitTermination()
    sink(events.select(F.col("event_id").alias("id"), F.lit("none").alias("agent"), F.lit("again").alias("thought"), F.col("ts").alias("created_at")), min(seen))
    return store.current("inner_monologue").groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.count_distinct("thought").alias("kinds"))


SQL["stream_into_store"] = "SELECT 'u' || CAST(user_id % 25 AS VARCHAR) AS agent, count(*) AS n, max(event_id) AS last, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1"


def graph_domain_edges(spark, sf):
    """The edges among an agent's memories of one domain."""
    return G.similarity_edges(W.embedded(W.memories(spark, sf)), domain="technical").select("agent", "src", "dst", F.round("weight", 6).alias("weight"))


SQL["graph_domain_edges"] = f"""WITH {upkeep.PAIRS_SQL}, dm AS ({upkeep.SQL['domain_classify'].split(W.MEM)[1].strip()}), bi AS (SELECT agent, a, b, similarity FROM pairs WHERE similarity >= 0.7 UNION ALL SELECT agent, b, a, similarity FROM pairs WHERE similarity >= 0.7),
r AS (SELECT bi.*, row_number() OVER (PARTITION BY agent, a ORDER BY similarity DESC, b) AS n FROM bi JOIN dm x ON x.id = a JOIN dm y ON y.id = b WHERE x.domain = 'technical' AND y.domain = 'technical')
SELECT agent, a AS src, b AS dst, round(similarity, 6) AS weight FROM r WHERE n <= 20"""


for _f in (stream_into_store, store_lifecycle, store_insert_ids, store_two_writers, memory_get, memory_list_all, search_like, contract_breaks, schema_catalog, schema_contract_diff, key_sets, vector_guards, secrets_and_slugs, row_defaults, ocean_valid, clamped_similarity, sleep_report, sleep_summary, sleep_live, graph_stats, graph_domain_edges, agent_memories, agent_rules, agent_instincts, agent_identity, agent_reflections, agent_procedures, integrity_seals, migration_reembed, merkle_root, merkle_proof, hash_chain_head, rows_fingerprint, trie_has_key, fenwick_point_query, spatial_predicates, stream_activity_windows):
    QUERIES[_f.__name__] = _f
