"""Queries on consolidation, routing, the graph and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agents as A
from ..operators import consolidation as C
from ..operators import graph as G
from . import views as W

QUERIES, SQL = {}, {}
PAIRS_SQL = f"""{W.MEM}, {W.hash_sql('d', 'mem', 'id', 'content')},
dots AS (SELECT a.key AS a, b.key AS b, CAST(sum(x.n * y.n) AS DOUBLE) AS dot FROM (SELECT id AS key, agent FROM mem WHERE invalid_at IS NULL) a JOIN (SELECT id AS key, agent FROM mem WHERE invalid_at IS NULL) b ON a.agent = b.agent AND a.key < b.key
  JOIN d_c x ON x.key = a.key JOIN d_c y ON y.key = b.key AND x.bucket = y.bucket GROUP BY ALL),
pairs AS (SELECT m.agent, a, b, dot / (p.norm * q.norm) AS similarity FROM dots JOIN d_n p ON p.key = a JOIN d_n q ON q.key = b JOIN mem m ON m.id = a)"""


def sleep_replay(spark, sf):
    return C.replay(W.memories(spark, sf), W.as_of()).filter("affected").select("id", F.round("relevance_score", 6).alias("relevance_score"))


def sleep_forget(spark, sf):
    return C.forget(W.memories(spark, sf), W.as_of()).filter("affected").select("id", F.round("relevance_score", 6).alias("relevance_score"), F.round("utility_score", 6).alias("utility_score"))


def sleep_prune(spark, sf):
    return C.prune(W.memories(spark, sf), W.as_of()).filter("affected").select("agent", "id")


_DEF = "CASE WHEN relevance_score = 0 THEN 1.0 ELSE relevance_score END"
SQL["sleep_replay"] = f"WITH {W.MEM} SELECT id, round(least(1.0, {_DEF} + 0.1), 6) AS relevance_score FROM mem WHERE invalid_at IS NULL AND last_activation > 1782864000 - 86400"
_STALE = "invalid_at IS NULL AND importance <= 7 AND (last_activation IS NULL OR last_activation < 1782864000 - 14 * 86400)"
SQL["sleep_forget"] = f"WITH {W.MEM} SELECT id, round({_DEF} * (1 - (1 - 0.85) / (1 + 0.5 * abs(valence) + 0.3 * arousal)), 6) AS relevance_score, round(greatest(0.0, CASE WHEN utility_score = 0 THEN 0.5 ELSE utility_score END - 0.03), 6) AS utility_score FROM mem WHERE {_STALE}"
SQL["sleep_prune"] = f"WITH {W.MEM}, r AS (SELECT agent, id, row_number() OVER (PARTITION BY agent ORDER BY relevance_score, id) AS n FROM mem WHERE invalid_at IS NULL AND relevance_score < 0.05 AND importance <= 5 AND NOT identity_defining) SELECT agent, id FROM r WHERE n <= 50"


def sleep_duplicate_pairs(spark, sf):
    return C.merge_pairs(W.embedded(W.memories(spark, sf))).select("agent", "a", "b", F.round("similarity", 6).alias("similarity"))


SQL["sleep_duplicate_pairs"] = f"WITH {PAIRS_SQL} SELECT agent, a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.92"


def sleep_consolidate(spark, sf):
    """The memories that merging invalidates or strengthens, and how often each won."""
    m = W.embedded(W.memories(spark, sf))
    return C.merge_decisions(m, C.merge_pairs(m)).select("agent", "id", "invalidated", F.round("relevance_score", 6).alias("relevance_score"), "merges")


def dmem_route(spark, sf):
    """Every conversation turn, as a candidate of the agent that its conversation belongs to, against its newest memories."""
    c = W.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cand_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("agent"), "text", ((F.col("turn") % 10) / F.lit(10.0)).alias("utility"))
    out = C.route(W.embedded(c, "cand_id", "text"), W.embedded(C.newest(W.memories(spark, sf))))
    return out.select("cand_id", "agent", F.round("max_similarity", 6).alias("max_similarity"), F.round("surprise", 6).alias("surprise"), F.round("rpe", 6).alias("rpe"), "route")


SQL["dmem_route"] = f"""WITH {W.MEM}, cand AS (SELECT conv_id * 1000 + turn AS cand_id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS agent, text, CAST(turn % 10 AS DOUBLE) / 10 AS utility FROM conversations),
past AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS n FROM mem WHERE invalid_at IS NULL) WHERE n <= 50),
{W.hash_sql('d', 'past', 'id', 'content')}, {W.hash_sql('c', 'cand', 'cand_id', 'text')},
dots AS (SELECT c.cand_id, p.id, CAST(sum(x.n * y.n) AS DOUBLE) AS dot FROM cand c JOIN past p ON p.agent = c.agent JOIN c_c x ON x.key = c.cand_id JOIN d_c y ON y.key = p.id AND y.bucket = x.bucket GROUP BY ALL),
best AS (SELECT cand_id, greatest(0.0, max(dot / (a.norm * b.norm))) AS s FROM dots JOIN c_n a ON a.key = cand_id JOIN d_n b ON b.key = id GROUP BY cand_id),
r AS (SELECT c.cand_id, c.agent, c.utility, coalesce(s, 0.0) AS s FROM cand c LEFT JOIN best USING (cand_id))
SELECT cand_id, agent, round(s, 6) AS max_similarity, round(1 - s, 6) AS surprise, round((1 - s) * utility, 6) AS rpe, CASE WHEN 1 - s < 0.3 AND utility < 0.6 THEN 'fast_path' ELSE 'full_processing' END AS route FROM r"""


def graph_similarity_edges(spark, sf):
    return G.similarity_edges(W.embedded(W.memories(spark, sf))).select("agent", "src", "dst", "type", F.round("weight", 6).alias("weight"))


SQL["graph_similarity_edges"] = f"""WITH {PAIRS_SQL}, bi AS (SELECT agent, a, b, similarity FROM pairs WHERE similarity >= 0.7 UNION ALL SELECT agent, b, a, similarity FROM pairs WHERE similarity >= 0.7),
r AS (SELECT *, row_number() OVER (PARTITION BY agent, a ORDER BY similarity DESC, b) AS n FROM bi)
SELECT r.agent, a AS src, b AS dst, CASE WHEN x.category = 'correction' OR y.category = 'correction' THEN 'INHIBITS' ELSE 'EXCITES' END AS type, round(similarity, 6) AS weight FROM r JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE n <= 20"""


def graph_semantic_conflicts(spark, sf):
    return G.semantic_conflicts(W.embedded(W.memories(spark, sf))).select("agent", "memory_id_a", "memory_id_b", "conflict_type", "signal")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SIGNAL = "CASE " + " ".join(f"WHEN contains(lower(x.content), {_q(k)}) <> contains(lower(y.content), {_q(k)}) THEN {_q(k.strip())}" for k in X.CONTRADICTION_KEYWORDS) + " WHEN x.category = 'correction' OR y.category = 'correction' THEN 'correction_category' END"
SQL["graph_semantic_conflicts"] = f"WITH {PAIRS_SQL}, s AS (SELECT p.agent, a AS memory_id_a, b AS memory_id_b, 'semantic_contradiction' AS conflict_type, {_SIGNAL} AS signal FROM pairs p JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE similarity >= 0.85) SELECT * FROM s WHERE signal IS NOT NULL"


def graph_edge_contradictions(spark, sf):
    """Events as edges between users and event types' numbers, some of each kind."""
    e = W.table(spark, sf, "events")
    edges = e.select(F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("agent"), F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"), F.when(F.col("event_id") % 3 == 0, "INHIBITS").when(F.col("event_id") % 3 == 1, "EXCITES").otherwise("MENTIONS").alias("type"), F.col("value").alias("weight"))
    return G.edge_contradictions(edges).withColumn("similarity", F.round("similarity", 6))


SQL["graph_edge_contradictions"] = """WITH e AS (SELECT 'a' || CAST(user_id % 7 AS VARCHAR) AS agent, user_id AS src, event_id % 50 AS dst, CASE event_id % 3 WHEN 0 THEN 'INHIBITS' WHEN 1 THEN 'EXCITES' ELSE 'MENTIONS' END AS type, value AS weight FROM events)
SELECT agent, src AS memory_id_a, dst AS memory_id_b, 'edge_contradiction' AS conflict_type, round(max(weight), 6) AS similarity FROM e GROUP BY ALL HAVING bool_or(type = 'EXCITES') AND bool_or(type = 'INHIBITS')"""
SQL["graph_edge_contradictions"] = SQL["graph_edge_contradictions"].replace("GROUP BY ALL", "GROUP BY agent, src, dst")


def graph_mentions(spark, sf):
    return G.mentions(W.memories(spark, sf))


def graph_entities(spark, sf):
    return G.entities(G.mentions(W.memories(spark, sf)))


# RE2 knows ASCII word boundaries only, so other letters are made underscores for the patterns that have some.
_ASCII = r"regexp_replace(content, '[^\x00-\x7F]', '_', 'g')"
_FOUND = [(f"regexp_extract_all({_ASCII if p.startswith(chr(92)) else 'content'}, {_q(p)}, 1)", k) for p, k in X.ENTITY_PATTERNS]
_ENT = f"""{W.MEM}, f AS (SELECT agent, id, list_concat({', '.join(f"list_transform({x}, lambda x: struct_pack(entity := x, entity_type := '{k}'))" for x, k in _FOUND)}) AS l FROM mem WHERE invalid_at IS NULL),
u AS (SELECT agent, id, unnest(l) AS e, unnest(range(len(l))) AS o FROM f), g AS (SELECT agent, id, trim(e.entity) AS entity, e.entity_type AS entity_type, o FROM u),
h AS (SELECT *, row_number() OVER (PARTITION BY agent, id, lower(entity) ORDER BY o) AS n FROM g WHERE length(entity) > 1),
mentions AS (SELECT agent, id AS memory_id, entity, entity_type FROM h WHERE n = 1)"""
SQL["graph_mentions"] = f"WITH {_ENT} SELECT * FROM mentions"
SQL["graph_entities"] = f"WITH {_ENT} SELECT agent, entity, arg_min(entity_type, memory_id) AS entity_type, count(DISTINCT memory_id) AS mention_count FROM mentions GROUP BY agent, entity"


def domain_classify(spark, sf):
    m = W.memories(spark, sf)
    return m.select("id", X.classify_domain(F.col("category"), F.col("content")).alias("domain"))


_CATS = " ".join(f"WHEN category = '{k}' THEN '{v}'" for k, v in X.CATEGORY_DOMAIN.items())
_KEYS = " ".join("WHEN " + " OR ".join(f"contains(lower(content), {_q(w.lower())})" for w in ws) + f" THEN '{d}'" for d, ws in X.DOMAIN_KEYWORDS)
SQL["domain_classify"] = f"WITH {W.MEM} SELECT id, CASE {_CATS} {_KEYS} ELSE 'general' END AS domain FROM mem"


# Agents: users are agents, events their logs.
def _identity(spark, sf):
    c = W.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("agent"), *[((F.col("c_custkey") * m) % 101 / F.lit(100.0)).alias(k) for k, m in zip("OCEAN", (7, 11, 13, 17, 19), strict=True)])


_IDN = "idn AS (SELECT c_custkey AS agent, " + ", ".join(f'CAST((c_custkey * {m}) % 101 AS DOUBLE) / 100 AS "{k}_"' for k, m in zip("OCEAN", (7, 11, 13, 17, 19), strict=True)) + " FROM customer)"


def ocean_narrative(spark, sf):
    i = _identity(spark, sf)
    return i.select("agent", A.ocean_narrative(*[F.col(k) for k in "OCEAN"]).alias("narrative"))


_NARRATIVE = """'Soy ' || CASE WHEN "C_" >= 0.8 THEN 'extremadamente meticuloso y organizado' WHEN "C_" >= 0.6 THEN 'organizado y confiable' ELSE 'flexible con la estructura' END
 || ', ' || CASE WHEN "O_" >= 0.7 THEN 'abierto a nuevas ideas' WHEN "O_" >= 0.5 THEN 'moderadamente curioso' ELSE 'pragmatico y convencional' END
 || ', ' || CASE WHEN "N_" <= 0.15 THEN 'muy estable emocionalmente' WHEN "N_" <= 0.3 THEN 'emocionalmente estable bajo presion' ELSE 'sensible emocionalmente' END
 || ', ' || CASE WHEN "A_" >= 0.7 THEN 'cooperativo con el equipo' WHEN "A_" >= 0.5 THEN 'equilibrado entre autonomia y colaboracion' ELSE 'independiente en sus juicios' END
 || ', y ' || CASE WHEN "E_" >= 0.7 THEN 'energizado por la interaccion directa' WHEN "E_" >= 0.4 THEN 'selectivo en sus interacciones' ELSE 'introvertido — prefiere el pensamiento profundo' END || '.'"""
SQL["ocean_narrative"] = f"WITH {_IDN} SELECT agent, {_NARRATIVE} AS narrative FROM idn"


def ocean_drift(spark, sf):
    i = _identity(spark, sf)
    return i.select("agent", A.drift(F.col("O"), F.col("C")).alias("O_next"), A.drift(F.col("N"), F.col("E"), 0.2).alias("N_next"))


SQL["ocean_drift"] = f"""WITH {_IDN} SELECT agent, round(greatest(0.0, least(1.0, "O_" + greatest(-0.05, least(0.05, "C_" - "O_")))), 4) AS O_next, round(greatest(0.0, least(1.0, "N_" + greatest(-0.2, least(0.2, "E_" - "N_")))), 4) AS N_next FROM idn"""


def identity_partial_upsert(spark, sf):
    e = W.table(spark, sf, "events")
    k = F.col("event_id") % 3
    log = e.select(F.col("user_id").alias("agent"), F.col("event_id").alias("seq"), F.when(k == 0, F.concat(F.lit("p"), "event_type")).alias("personality"), F.when(k == 1, F.concat(F.lit("b"), "event_type")).alias("boot_context"), F.when(k == 2, F.col("props")).alias("philosophy"))
    return A.partial_upsert(log, ["agent"], ["personality", "boot_context", "philosophy"])


SQL["identity_partial_upsert"] = "SELECT user_id AS agent, arg_max('p' || event_type, event_id) FILTER (WHERE event_id % 3 = 0) AS personality, arg_max('b' || event_type, event_id) FILTER (WHERE event_id % 3 = 1) AS boot_context, arg_max(props, event_id) FILTER (WHERE event_id % 3 = 2) AS philosophy FROM events GROUP BY user_id"


def _relationships(spark, sf):
    c, n = W.table(spark, sf, "customer"), W.table(spark, sf, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("agent"), F.col("c_name").alias("person"), F.round((F.col("c_acctbal") + 1000) / 11000, 6).alias("trust_level"), F.lit("default").alias("style"))


_REL = "rel AS (SELECT c_custkey AS id, n_name AS agent, c_name AS person, round(CAST(c_acctbal + 1000 AS DOUBLE) / 11000, 6) AS trust_level, 'default' AS style FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def relationships_ranked(spark, sf):
    return A.relationships_ranked(_relationships(spark, sf)).select("agent", "person", "trust_level", "rank")


SQL["relationships_ranked"] = f"WITH {_REL} SELECT agent, person, trust_level, CAST(row_number() OVER (PARTITION BY agent ORDER BY trust_level DESC, person) AS INTEGER) AS rank FROM rel"


def _rule_log(spark, sf):
    e, i = W.table(spark, sf, "events"), F.col("event_id")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("agent"), F.concat(F.lit("k"), (i % 12).cast("string")).alias("rule_key"), F.concat(F.lit("rule "), i.cast("string")).alias("content"), F.when(i % 4 == 0, "critical").when(i % 4 == 1, "high").otherwise("normal").alias("priority"), (i % 9 != 0).alias("active"), i.alias("created_at"), i.alias("seq"))


_RULES = """rl AS (SELECT 'u' || CAST(user_id % 25 AS VARCHAR) AS agent, 'k' || CAST(event_id % 12 AS VARCHAR) AS rule_key, 'rule ' || CAST(event_id AS VARCHAR) AS content, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'normal' END AS priority, event_id % 9 <> 0 AS active, event_id AS seq FROM events),
rules AS (SELECT agent, rule_key, arg_max(content, seq) AS content, arg_max(priority, seq) AS priority, arg_max(active, seq) AS active, min(seq) AS created_at FROM rl GROUP BY agent, rule_key)"""


def rules_upsert_latest(spark, sf):
    return A.rules_upsert(_rule_log(spark, sf)).select("agent", "rule_key", "content", "priority", "active", "created_at")


def rules_list(spark, sf):
    return A.rules_list(A.rules_upsert(_rule_log(spark, sf))).select("agent", "rule_key", "priority", "rank")


def rules_critical(spark, sf):
    return A.rules_critical(A.rules_upsert(_rule_log(spark, sf))).select("agent", "rule_key", "rank")


SQL["rules_upsert_latest"] = f"WITH {_RULES} SELECT * FROM rules"
SQL["rules_list"] = f"WITH {_RULES} SELECT agent, rule_key, priority, CAST(row_number() OVER (PARTITION BY agent ORDER BY priority DESC, created_at, rule_key) AS INTEGER) AS rank FROM rules WHERE active"
SQL["rules_critical"] = f"WITH {_RULES}, r AS (SELECT agent, rule_key, CAST(row_number() OVER (PARTITION BY agent ORDER BY created_at, rule_key) AS INTEGER) AS rank FROM rules WHERE active AND priority = 'critical') SELECT * FROM r WHERE rank <= 5"


def instinct_confidence(spark, sf):
    e = W.table(spark, sf, "events")
    inst = e.select(F.col("user_id").alias("id")).distinct().withColumn("agent", F.concat(F.lit("u"), (F.col("id") % 25).cast("string"))).withColumn("confidence", (F.col("id") % 7) / F.lit(7.0)).withColumn("activation_count", F.lit(0)).withColumn("last_activated", F.lit(None).cast("long"))
    acts = e.select(F.col("user_id").alias("instinct_id"), F.col("event_id").alias("at"))
    return A.instincts_list(A.instincts_after(inst, acts), 0.3).select("agent", "id", "confidence", F.col("activation_count").cast("long").alias("activation_count"), "rank")


SQL["instinct_confidence"] = """WITH i AS (SELECT user_id AS id, 'u' || CAST(user_id % 25 AS VARCHAR) AS agent, CAST(user_id % 7 AS DOUBLE) / 7 AS c, count(*) AS n FROM events GROUP BY user_id),
g AS (SELECT *, CASE WHEN n > 0 THEN round(least(1.0, 1 - (1 - c) * pow(0.9, n)), 4) ELSE c END AS confidence FROM i)
SELECT agent, id, confidence, n AS activation_count, CAST(row_number() OVER (PARTITION BY agent ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM g WHERE confidence >= 0.3"""


def _monologue(spark, sf):
    c = W.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("u"), (F.col("conv_id") % 25).cast("string")).alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("thought"), F.col("role").alias("emotional_state"), F.timestamp_seconds(F.lit(W.START) + F.col("turn") * 60 + F.col("conv_id")).alias("created_at"))


_MONO = "mono AS (SELECT conv_id * 1000 + turn AS id, 'u' || CAST(conv_id % 25 AS VARCHAR) AS agent, CAST(conv_id AS VARCHAR) AS session_id, text AS thought, role AS emotional_state, 1735689600 + turn * 60 + conv_id AS created_at FROM conversations)"


def thought_last(spark, sf):
    return A.last_by_agent(_monologue(spark, sf)).select("agent", "id", "thought")


def thought_recent_by_session(spark, sf):
    return A.thoughts(_monologue(spark, sf)).select("agent", "session_id", "id", "rank")


def diary_last(spark, sf):
    d = _monologue(spark, sf).filter("emotional_state = 'user'").withColumn("session_date", F.to_date(F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm"), 1, 10)))
    return A.last_by_agent(d).select("agent", "id", F.substring("thought", 1, 100).alias("content"))


SQL["thought_last"] = f"WITH {_MONO}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS n FROM mono) SELECT agent, id, thought FROM r WHERE n = 1"
SQL["thought_recent_by_session"] = f"WITH {_MONO}, r AS (SELECT agent, session_id, id, CAST(row_number() OVER (PARTITION BY agent, session_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank FROM mono) SELECT * FROM r WHERE rank <= 10"
SQL["diary_last"] = f"WITH {_MONO}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS n FROM mono WHERE emotional_state = 'user') SELECT agent, id, substr(thought, 1, 100) AS content FROM r WHERE n = 1"


def _procs(spark, sf):
    p = W.table(spark, sf, "part")
    d = F.col("p_name")
    q = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("u"), (F.col("p_partkey") % 5).cast("string")).alias("agent"), F.when(F.col("p_partkey") % 3 == 0, "build").otherwise("general").alias("task_type"), d.alias("task_description"))
    return q


_PROC = "prc AS (SELECT p_partkey AS id, 'u' || CAST(p_partkey % 5 AS VARCHAR) AS agent, CASE WHEN p_partkey % 3 = 0 THEN 'build' ELSE 'general' END AS task_type, p_name AS task_description FROM part)"


def procedure_search(spark, sf):
    """For each agent the first word of its part names that comes last in text order, asked as a prefix."""
    p = _procs(spark, sf)
    q = p.groupBy("agent").agg(F.max(F.substring_index("task_description", " ", 1)).alias("query")).withColumn("query_id", F.substring("agent", 2, 9).cast("long"))
    out = A.procedure_search(X.hash_embed(p, "id", "task_description", "vec"), X.hash_embed(q, "query_id", "query", "query_vec"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "match_type", "rank")


SQL["procedure_search"] = f"""WITH {_PROC}, qr AS (SELECT agent, CAST(substr(agent, 2) AS BIGINT) AS query_id, max(string_split(task_description, ' ')[1]) AS query FROM prc GROUP BY agent),
{W.hash_sql('d', 'prc', 'id', 'task_description')}, {W.hash_sql('q', 'qr', 'query_id', 'query')},
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent, task_description ORDER BY id DESC) AS l FROM prc) WHERE l = 1),
pre AS (SELECT * FROM (SELECT query_id, kp.id, row_number() OVER (PARTITION BY query_id ORDER BY task_description, kp.id) AS o FROM kp JOIN qr USING (agent) WHERE starts_with(task_description, query)) WHERE o <= 5),
dots AS (SELECT qr.query_id, prc.id, CAST(sum(x.n * y.n) AS DOUBLE) AS dot FROM qr JOIN prc USING (agent) JOIN q_c x ON x.key = qr.query_id JOIN d_c y ON y.key = prc.id AND x.bucket = y.bucket GROUP BY ALL),
sem AS (SELECT qr.query_id, prc.id, coalesce(dot / (a.norm * b.norm), 0) AS score FROM qr JOIN prc USING (agent) LEFT JOIN dots ON dots.query_id = qr.query_id AND dots.id = prc.id LEFT JOIN q_n a ON a.key = qr.query_id LEFT JOIN d_n b ON b.key = prc.id),
al AS (SELECT query_id, id, CAST(1 AS DOUBLE) AS score, 'prefix' AS match_type FROM pre UNION ALL SELECT query_id, id, score, 'semantic' FROM sem WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.query_id = sem.query_id AND pre.id = sem.id)),
r AS (SELECT query_id, id, round(score, 6) AS score, match_type, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_type, id) AS INTEGER) AS rank FROM al) SELECT * FROM r WHERE rank <= 5"""


def procedure_success_rate(spark, sf):
    p = W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[F.lit(0).alias(f"{k}_count") for k in ("hit", "success", "fail")])
    ev = W.table(spark, sf, "events").select((F.col("event_id") % 700).alias("id"), F.when(F.col("event_id") % 5 == 0, "hit").when(F.col("event_id") % 5 < 3, "success").otherwise("fail").alias("kind"))
    out = A.procedure_counters(p, ev)
    return out.select("id", *[F.col(f"{k}_count").cast("long").alias(f"{k}_count") for k in ("hit", "success", "fail")], F.round("success_rate", 6).alias("success_rate"))


SQL["procedure_success_rate"] = """WITH n AS (SELECT event_id % 700 AS id, count(*) FILTER (WHERE event_id % 5 = 0) AS h, count(*) FILTER (WHERE event_id % 5 IN (1, 2)) AS s, count(*) FILTER (WHERE event_id % 5 > 2) AS f FROM events GROUP BY 1)
SELECT p_partkey AS id, coalesce(h, 0) AS hit_count, coalesce(s, 0) AS success_count, coalesce(f, 0) AS fail_count, CASE WHEN coalesce(s + f, 0) = 0 THEN 0.0 ELSE round(CAST(s AS DOUBLE) / (s + f), 6) END AS success_rate FROM part LEFT JOIN n ON id = p_partkey"""


def boot_context(spark, sf):
    agents = W.table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("agent")).distinct()
    n = F.substring("agent", 2, 9).cast("int")
    ocean = F.map_from_arrays(F.array(*[F.lit(k) for k in "OCEAN"]), F.array(*[((n * m) % 101 / F.lit(100.0)) for m in (7, 11, 13, 17, 19)]))
    ident = agents.select("agent", F.concat(F.lit("Person "), "agent").alias("personality"), F.when(n % 2 == 0, ocean).otherwise(F.create_map().cast("map<string,double>")).alias("ocean_scores"))
    rel = W.table(spark, sf, "supplier").select(F.concat(F.lit("u"), (F.col("s_suppkey") % 25).cast("string")).alias("agent"), F.col("s_name").alias("person"), ((F.col("s_suppkey") * 7) % 100 / F.lit(100.0)).alias("trust_level"), F.lit("default").alias("style"))
    return A.boot_text(ident, rel, A.rules_upsert(_rule_log(spark, sf)), _monologue(spark, sf)).select("agent", F.sha2("boot", 256).alias("boot_sha256"), F.length("boot").cast("long").alias("n_chars"))


_FMT = " || ', ' || ".join(f"'{k}=' || printf('%.3f', \"{k}_\")" for k in "ACENO")
SQL["boot_context"] = f"""WITH {_RULES}, {_MONO}, ag AS (SELECT DISTINCT 'u' || CAST(user_id % 25 AS VARCHAR) AS agent, user_id % 25 AS n FROM events),
oc AS (SELECT agent, n, {', '.join(f'CAST((n * {m}) % 101 AS DOUBLE) / 100 AS "{k}_"' for k, m in zip('OCEAN', (7, 11, 13, 17, 19), strict=True))} FROM ag),
sr AS (SELECT 'u' || CAST(s_suppkey % 25 AS VARCHAR) AS agent, s_name AS person, CAST((s_suppkey * 7) % 100 AS DOUBLE) / 100 AS trust FROM supplier),
rl2 AS (SELECT agent, string_agg('- ' || person || ': trust=' || CAST(trust AS VARCHAR) || ', style=default', chr(10) ORDER BY trust DESC, person) AS t FROM sr GROUP BY agent),
cr AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at, rule_key) AS i FROM rules WHERE active AND priority = 'critical'),
cr2 AS (SELECT agent, string_agg('- ' || rule_key || ': ' || substr(content, 1, 100), chr(10) ORDER BY i) AS t FROM cr WHERE i <= 5 GROUP BY agent),
lt AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, id DESC) AS i FROM mono),
lt2 AS (SELECT agent, chr(10) || '## Last Inner Thought [' || coalesce(emotional_state, '') || ']' || chr(10) || '(' || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%S') || '): ' || thought AS t FROM lt WHERE i = 1),
b AS (SELECT agent, concat_ws(chr(10), '## Identity: ' || agent, 'Person ' || agent, CASE WHEN n % 2 = 0 THEN 'OCEAN Profile: ' || {_FMT} || chr(10) || 'OCEAN Narrative: ' || {_NARRATIVE} END,
  chr(10) || '## Relationships' || chr(10) || rl2.t, chr(10) || '## Critical Rules' || chr(10) || cr2.t, lt2.t,
  chr(10) || '## Boot Protocol' || chr(10) || 'You are ' || agent || '. Use memory search for deeper recall. Your memories live in the database, always accessible.') AS boot
  FROM oc LEFT JOIN rl2 USING (agent) LEFT JOIN cr2 USING (agent) LEFT JOIN lt2 USING (agent))
SELECT agent, sha256(boot) AS boot_sha256, length(boot) AS n_chars FROM b"""


def snapshot_state(spark, sf):
    m = W.memories(spark, sf).withColumn("agent", F.concat(F.lit("u"), (F.col("id") % 25).cast("string")))
    agents = m.select("agent").distinct()
    inst = W.table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().select("id", F.concat(F.lit("u"), (F.col("id") % 25).cast("string")).alias("agent"))
    out = A.snapshot(agents, m, A.rules_upsert(_rule_log(spark, sf)), inst, _monologue(spark, sf))
    return out.select("agent", F.array_join(F.col("recent_memories").cast("array<string>"), ",").alias("recent_memories"), "n_rules", "n_instincts", "last_thought")


SQL["snapshot_state"] = f"""WITH {W.MEM}, {_RULES}, {_MONO}, m AS (SELECT *, 'u' || CAST(id % 25 AS VARCHAR) AS ag FROM mem),
r AS (SELECT ag, id, row_number() OVER (PARTITION BY ag ORDER BY created_at DESC, id DESC) AS n FROM m WHERE invalid_at IS NULL), rm AS (SELECT ag, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS recent_memories FROM r WHERE n <= 10 GROUP BY ag),
nr AS (SELECT agent, count(*) AS n_rules FROM rules WHERE active GROUP BY agent), ni AS (SELECT 'u' || CAST(user_id % 25 AS VARCHAR) AS agent, count(DISTINCT user_id) AS n_instincts FROM events GROUP BY 1), lt AS (SELECT agent, arg_max(thought, struct_pack(c := created_at, i := id)) AS last_thought FROM mono GROUP BY agent)
SELECT a.ag AS agent, recent_memories, coalesce(n_rules, 0) AS n_rules, coalesce(n_instincts, 0) AS n_instincts, last_thought FROM (SELECT DISTINCT ag FROM m) a LEFT JOIN rm ON rm.ag = a.ag LEFT JOIN nr ON nr.agent = a.ag LEFT JOIN ni ON ni.agent = a.ag LEFT JOIN lt ON lt.agent = a.ag"""

for _f in (sleep_replay, sleep_forget, sleep_prune, sleep_duplicate_pairs, sleep_consolidate, dmem_route, graph_similarity_edges, graph_semantic_conflicts, graph_edge_contradictions, graph_mentions, graph_entities, domain_classify, ocean_narrative, ocean_drift, identity_partial_upsert, relationships_ranked, rules_upsert_latest, rules_list, rules_critical, instinct_confidence, thought_last, thought_recent_by_session, diary_last, procedure_search, procedure_success_rate, boot_context, snapshot_state):
    QUERIES[_f.__name__] = _f
