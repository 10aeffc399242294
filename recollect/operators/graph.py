"""The memory graph: similarity edges, entities and mentions, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import Scratch
from .memory import live
from .vectors import neighbour_counts, neighbours, similar_pairs

SIMILARITY, NEIGHBOURS, CONFLICT_AT = 0.70, 20, 0.85


def in_domain(df: DataFrame, domain: str = "") -> DataFrame:
    return df.filter(X.classify_domain(F.col("category"), F.col("content")) == domain) if domain else df


def similarity_edges(memories: DataFrame, threshold: float = SIMILARITY, limit: int = NEIGHBOURS, domain: str = "") -> DataFrame:
    """(agent, src, dst, type, weight): each memory's most similar others; INHIBITS if either is a correction, else EXCITES."""
    m = in_domain(live(memories), domain)
    near = neighbours(m, threshold, limit)
    cat = m.select("agent", "id", "category")
    out = near.join(cat.withColumnsRenamed({"id": "a", "category": "ca"}), ["agent", "a"]).join(cat.withColumnsRenamed({"id": "b", "category": "cb"}), ["agent", "b"])
    kind = F.when((F.col("ca") == "correction") | (F.col("cb") == "correction"), "INHIBITS").otherwise("EXCITES")
    return out.select("agent", F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("type"), F.col("similarity").alias("weight"))


def edge_counts(memories: DataFrame, threshold: float = SIMILARITY, limit: int = NEIGHBOURS, domain: str = "") -> DataFrame:
    """(agent, edges): how many similarity edges each agent has; a memory that has its `limit` is not looked at further."""
    m = in_domain(live(memories), domain)
    return neighbour_counts(m, threshold, limit).groupBy("agent").agg(F.sum("n").alias("edges"))


def edge_contradictions(edges: DataFrame) -> DataFrame:
    """Node pairs with both EXCITES and INHIBITS edges, with the largest weight of all their edges."""
    g = edges.groupBy("agent", "src", "dst").agg(F.max((F.col("type") == "EXCITES").cast("int")).alias("e"), F.max((F.col("type") == "INHIBITS").cast("int")).alias("i"), F.max("weight").alias("similarity"))
    return g.filter("e = 1 and i = 1").select("agent", F.col("src").alias("memory_id_a"), F.col("dst").alias("memory_id_b"), F.lit("edge_contradiction").alias("conflict_type"), "similarity")


def semantic_conflicts(memories: DataFrame, threshold: float = CONFLICT_AT, domain: str = "", keywords: tuple[str, ...] = X.CONTRADICTION_KEYWORDS) -> DataFrame:
    """Similar pairs of which one holds a contradiction signal that the other lacks, or either is a correction."""
    m = in_domain(live(memories), domain)
    pairs = similar_pairs(m, threshold)
    # What a text signals is found once a memory; no pair carries a text.
    side = m.select("agent", "id", F.coalesce(F.col("category") == "correction", F.lit(False)).alias("fix"), X.signals(F.col("content"), keywords).alias("held"))
    side = Scratch(memories.sparkSession).write(side, "signals")
    p = pairs.join(side.withColumnsRenamed({"id": "a", "fix": "fa", "held": "ha"}), ["agent", "a"]).join(side.withColumnsRenamed({"id": "b", "fix": "fb", "held": "hb"}), ["agent", "b"])
    word = X.contradiction_of(F.col("ha"), F.col("hb"), keywords)
    fix = F.col("fa") | F.col("fb")
    p = p.withColumn("signal", F.coalesce(word, F.when(fix, "correction_category"))).filter(F.col("signal").isNotNull())
    detail = F.format_string("High similarity (%.3f) with contradiction signal: '%s'", "similarity", "signal")
    return p.select("agent", F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"), F.lit("semantic_contradiction").alias("conflict_type"), F.round("similarity", 4).alias("similarity"), "signal", detail.alias("detail"))


def mentions(memories: DataFrame, domain: str = "") -> DataFrame:
    """(agent, memory_id, entity, entity_type): what each live memory mentions."""
    m = in_domain(live(memories), domain)
    return X.extract_entities(m, ["agent", "id"], "content").select("agent", F.col("id").alias("memory_id"), "entity", "entity_type")


def entities(found: DataFrame) -> DataFrame:
    """One row per agent and entity name: the type of its first mention, and how many memories mention it."""
    return found.groupBy("agent", "entity").agg(F.min_by("entity_type", "memory_id").alias("entity_type"), F.count_distinct("memory_id").alias("mention_count"))


def graph_counts(memories: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """(agent, nodes, edges, entities): live memories, edges and different entity names of each agent."""
    return graph_totals(memories, edges.groupBy("agent").agg(F.count(F.lit(1)).alias("edges")), found)


def graph_totals(memories: DataFrame, counts: DataFrame, found: DataFrame) -> DataFrame:
    """As `graph_counts`, from the number of edges of each agent."""
    n = live(memories).groupBy("agent").agg(F.count(F.lit(1)).alias("nodes"))
    m = found.groupBy("agent").agg(F.count_distinct("entity").alias("entities"))
    return n.join(counts, "agent", "full").join(m, "agent", "full").fillna(0, ["nodes", "edges", "entities"])


def stats_summary(agent: str, nodes: int, edges: int, ents: int, dry_run: bool = True) -> str:
    return f"Connectome [{'DRY-RUN' if dry_run else 'LIVE'}] — {agent}: {nodes} nodes, {edges} edges, {ents} entities"


def conflict_summary(agent: str, conflicts: int, memories: int, edges: int) -> str:
    return f"Conflict scan [{agent}]: {conflicts} conflicts{' found' if conflicts else ''} ({memories} memories, {edges} edges scanned)"
