"""Identity, relationships, rules, instincts, reflections, procedures, and the boot text of each agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .vectors import knn_blocks

DRIFT_CAP = 0.05
TRAITS = ("A", "C", "E", "N", "O")


def latest(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def partial_upsert(log: DataFrame, key: list[str], cols: list[str], seq: str = "seq") -> DataFrame:
    """Of each key and column the last value that was set (not null)."""
    return log.groupBy(*key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def _ladder(x: Column, down: bool, *steps: tuple[float | None, str]) -> Column:
    out = None
    for at, words in steps[:-1]:
        hit = x <= at if down else x >= at
        out = F.when(hit, words) if out is None else out.when(hit, words)
    return out.otherwise(steps[-1][1])


def ocean_narrative(o: Column, c: Column, e: Column, a: Column, n: Column) -> Column:
    """A sentence on five scores, each 0.5 if unknown. The phrases and thresholds are fixed values."""
    o, c, e, a, n = (F.coalesce(x, F.lit(0.5)) for x in (o, c, e, a, n))
    parts = [
        _ladder(c, False, (0.8, "extremadamente meticuloso y organizado"), (0.6, "organizado y confiable"), (None, "flexible con la estructura")),
        _ladder(o, False, (0.7, "abierto a nuevas ideas"), (0.5, "moderadamente curioso"), (None, "pragmatico y convencional")),
        _ladder(n, True, (0.15, "muy estable emocionalmente"), (0.3, "emocionalmente estable bajo presion"), (None, "sensible emocionalmente")),
        _ladder(a, False, (0.7, "cooperativo con el equipo"), (0.5, "equilibrado entre autonomia y colaboracion"), (None, "independiente en sus juicios")),
        _ladder(e, False, (0.7, "energizado por la interaccion directa"), (0.4, "selectivo en sus interacciones"), (None, "introvertido — prefiere el pensamiento profundo")),
    ]
    return F.concat(F.lit("Soy "), F.concat_ws(", ", *parts[:-1]), F.lit(", y "), parts[-1], F.lit("."))


def valid_ocean(scores: Column) -> Column:
    """Whether all five scores (unknown: 0.5) lie in 0..1."""
    keys = F.array(*[F.lit(k) for k in TRAITS])
    return F.forall(keys, lambda k: F.coalesce(F.try_element_at(scores, k), F.lit(0.5)).between(0.0, 1.0))


def drift(old: Column, new: Column, cap: float = DRIFT_CAP) -> Column:
    """The old score moved towards the new one by `cap` at most (0: the default), within 0..1, to four places."""
    cap = cap or DRIFT_CAP
    step = F.greatest(F.lit(-cap), F.least(F.lit(cap), new - old))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), old + step)), 4)


def relationships_ranked(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("agent").orderBy(F.col("trust_level").desc(), "person")
    return df.withColumn("rank", F.row_number().over(w))


def rules_upsert(log: DataFrame) -> DataFrame:
    """Rules from a log of (agent, rule_key, content, priority, set_by, active, created_at, seq): the last write wins, an
    upsert makes a rule active again, and the first write's time stays."""
    born = Window.partitionBy("agent", "rule_key")
    return latest(log.withColumn("created_at", F.min("created_at").over(born)), ["agent", "rule_key"])


def rules_list(rules: DataFrame) -> DataFrame:
    """Active rules by priority as text, descending (so normal, high, critical), then by age."""
    w = Window.partitionBy("agent").orderBy(F.col("priority").desc(), "created_at", "rule_key")
    return rules.filter("active").withColumn("rank", F.row_number().over(w))


def rules_critical(rules: DataFrame, limit: int = 5) -> DataFrame:
    w = Window.partitionBy("agent").orderBy("created_at", "rule_key")
    return rules.filter("active and priority = 'critical'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def instincts_list(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    w = Window.partitionBy("agent").orderBy(F.col("confidence").desc(), "id")
    return (df.filter(F.col("confidence") >= min_confidence) if min_confidence > 0 else df).withColumn("rank", F.row_number().over(w))


def instincts_after(instincts: DataFrame, activations: DataFrame) -> DataFrame:
    """Instincts after a log of activations (instinct_id, at): counts added, confidence grown in closed form."""
    n = activations.groupBy(F.col("instinct_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    j = instincts.join(n, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    grown = F.when(F.col("_n") > 0, scoring.grown_confidence(F.col("confidence"), F.col("_n"))).otherwise(F.col("confidence"))
    return j.withColumn("confidence", grown).withColumn("activation_count", F.col("activation_count") + F.col("_n")).withColumn("last_activated", F.coalesce("_at", "last_activated")).drop("_n", "_at")


def last_by_agent(df: DataFrame) -> DataFrame:
    return latest(df, ["agent"], "id") if "created_at" not in df.columns else latest(df.withColumn("_o", F.struct("created_at", "id")), ["agent"], "_o").drop("_o")


def thoughts(df: DataFrame, limit: int = 10) -> DataFrame:
    """The newest thoughts of each agent's session."""
    w = Window.partitionBy("agent", "session_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def procedure_search(procs: DataFrame, queries: DataFrame, top_k: int = 5, task_type: str = "") -> DataFrame:
    """(query_id, id, score, match_type, rank): descriptions that begin with the query first (score 1), then by cosine.

    Rows without a vector are found by prefix only. Of equal descriptions only the last inserted is found by prefix; the first `top_k` prefixes in text order are
    taken before the task type is looked at. procs (agent, id, task_type, task_description, vec), queries (agent,
    query_id, query, query_vec).
    """
    last = Window.partitionBy("agent", "task_description").orderBy(F.col("id").desc())
    keys = procs.withColumn("_l", F.row_number().over(last)).filter("_l = 1").drop("_l")
    order = Window.partitionBy("query_id").orderBy("task_description", "id")
    pre = keys.join(queries, "agent").filter(F.startswith("task_description", "query")).withColumn("_o", F.row_number().over(order)).filter(F.col("_o") <= top_k)
    if task_type:
        pre, procs = pre.filter(F.col("task_type") == task_type), procs.filter(F.col("task_type") == task_type)
    pre = pre.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("prefix").alias("match_type"))
    # Of the nearest at most top_k are prefixes too, so twice as many are enough.
    sem = knn_blocks(queries, procs, 2 * top_k).select("query_id", "id", F.col("similarity").alias("score"), F.lit("semantic").alias("match_type"))
    both = pre.unionByName(sem.join(pre.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("match_type"), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def procedure_counters(procs: DataFrame, events: DataFrame) -> DataFrame:
    """Counters after a log of outcomes (id, kind: hit, success or fail)."""
    n = events.groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("hit", "success", "fail")])
    out = procs.join(n, "id", "left")
    for k in ("hit", "success", "fail"):
        out = out.withColumn(f"{k}_count", F.col(f"{k}_count") + F.coalesce(f"_{k}", F.lit(0)))
    return out.drop("_hit", "_success", "_fail").withColumn("success_rate", scoring.success_rate(F.col("success_count"), F.col("fail_count")))


def boot_text(identity: DataFrame, relationships: DataFrame, rules: DataFrame, monologue: DataFrame) -> DataFrame:
    """(agent, boot): identity, OCEAN line and narrative, relationships by trust, critical rules, last thought, protocol.

    One row an agent from left joins of per-agent aggregates; the layout is a fixed format.
    """
    m = F.col("ocean_scores")
    g = lambda k: F.try_element_at(m, F.lit(k))
    scores = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))), ", ")
    base = identity.withColumn("_ocean", F.when(F.size(m) > 0, F.concat(F.lit("OCEAN Profile: "), scores, F.lit("\nOCEAN Narrative: "), ocean_narrative(g("O"), g("C"), g("E"), g("A"), g("N")))))
    rel = relationships_ranked(relationships).withColumn("_t", F.concat(F.lit("- "), "person", F.lit(": trust="), F.col("trust_level").cast("string"), F.lit(", style="), "style"))
    rel = rel.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]), "\n").alias("_rel"))
    crit = rules_critical(rules).withColumn("_t", F.concat(F.lit("- "), "rule_key", F.lit(": "), F.substring("content", 1, 100)))
    crit = crit.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]), "\n").alias("_crit"))
    last = last_by_agent(monologue).select("agent", F.concat(F.lit("\n## Last Inner Thought ["), F.coalesce("emotional_state", F.lit("")), F.lit("]\n("), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("): "), "thought").alias("_last"))
    j = base.join(rel, "agent", "left").join(crit, "agent", "left").join(last, "agent", "left")
    end = F.concat(F.lit("\n## Boot Protocol\nYou are "), "agent", F.lit(". Use memory search for deeper recall. Your memories live in the database, always accessible."))
    head = F.concat(F.lit("## Identity: "), "agent")
    parts = [head, F.when(F.col("personality") != "", F.col("personality")), "_ocean", F.concat(F.lit("\n## Relationships\n"), "_rel"), F.concat(F.lit("\n## Critical Rules\n"), "_crit"), "_last", end]
    return j.select("agent", F.concat_ws("\n", *parts).alias("boot"))


def snapshot(identity: DataFrame, memories: DataFrame, rules: DataFrame, instincts: DataFrame, monologue: DataFrame) -> DataFrame:
    """(agent, recent_memories, n_rules, n_instincts, last_thought): what an agent is now, ten newest memories included."""
    from .memory import recent

    mem = recent(memories, 10).groupBy("agent").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("recent_memories"))
    n_rules = rules.filter("active").groupBy("agent").agg(F.count(F.lit(1)).alias("n_rules"))
    n_inst = instincts.groupBy("agent").agg(F.count(F.lit(1)).alias("n_instincts"))
    last = last_by_agent(monologue).select("agent", F.col("thought").alias("last_thought"))
    out = identity.select("agent").join(mem, "agent", "left").join(n_rules, "agent", "left").join(n_inst, "agent", "left").join(last, "agent", "left")
    return out.fillna(0, ["n_rules", "n_instincts"])
