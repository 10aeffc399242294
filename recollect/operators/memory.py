"""Retrieval over memories: filters, hybrid search, lists and counts. Agents are keys, so one plan serves all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .vectors import cosine, is_zero, knn_blocks

SEARCH_LIMIT, CANDIDATES = 10, 100


def live(df: DataFrame, include_invalid: bool = False) -> DataFrame:
    return df if include_invalid else df.filter(F.col("invalid_at").isNull())


def matching(df: DataFrame, *, category: str = "", min_importance: int = 0, scope: str = "") -> DataFrame:
    """The conjunction of the conditions that are given."""
    terms = [c for on, c in ((category, F.col("category") == category), (min_importance, F.col("importance") >= min_importance), (scope, F.col("scope") == scope)) if on]
    return df.filter(reduce(lambda a, b: a & b, terms)) if terms else df


def scored(df: DataFrame, as_of: Column, floor: float = scoring.SEMANTIC_FLOOR) -> DataFrame:
    """Adds days_old and score to rows with a similarity."""
    df = df.withColumn("days_old", scoring.days_old(F.col("created_at"), as_of))
    s = scoring.decay_score(*[F.col(c) for c in ("similarity", "category", "importance", "valence", "arousal", "utility_score", "confidence_score", "days_old")])
    return df.withColumn("score", scoring.ranked_score(s, F.col("similarity"), F.col("importance"), floor))


def search(memories: DataFrame, queries: DataFrame, as_of: Column, *, limit: int = SEARCH_LIMIT, candidates: int | None = CANDIDATES, category: str = "", min_importance: int = 0, scope: str = "", literal: bool = True, floor: float = scoring.SEMANTIC_FLOOR, near: DataFrame | None = None) -> DataFrame:
    """query_id, id, similarity, score and rank of the best memories of each query's agent.

    memories have `vec`, queries (query_id, agent, query, query_vec). Without a filter the `candidates` nearest rows
    and, with `literal`, those that contain the query's text (case aside) are scored; with one, all rows that pass it
    (so a filter never hides a row); candidates=None scores everything. A row without a vector is found only
    literally. Ties go to the smaller id. All agents are answered at once, in blocks of an agent's rows. `near` (query_id,
    id, similarity) stands for the nearest rows where an index has found them; it is not used with a filter.
    """
    limit = limit or SEARCH_LIMIT
    filtered = bool(category or min_importance or scope)
    base = matching(live(memories), category=category, min_importance=min_importance, scope=scope)
    if near is None or filtered or candidates is None:
        near = knn_blocks(queries, base, None if filtered or candidates is None else candidates)
    near = near.select("query_id", "id", "similarity")
    if not (filtered or candidates is None):
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
        near = near.withColumn("_near", F.row_number().over(w)).filter(F.col("_near") <= candidates).drop("_near")
        if literal:
            said = base.join(queries.select("agent", "query_id", "query", F.col("query_vec").alias("_q")), "agent").filter((F.col("query") != "") & F.contains(F.lower("content"), F.lower("query")))
            said = said.select("query_id", "id", F.when(F.col("vec").isNotNull(), F.round(cosine(F.col("_q"), F.col("vec")), 12)).otherwise(0.0).alias("similarity"))
            near = near.unionByName(said).dropDuplicates(["query_id", "id"])
    pool = base.drop("vec").join(near, "id")
    out = scored(pool, as_of, floor)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "agent", "id", "similarity", "score", "rank")


def like_matches(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): live rows of the query's agent whose text is LIKE %query%, case aside.

    As in the fallback of the data model, `%` and `_` in a query are wildcards. An empty query matches nothing.
    """
    pairs = live(memories).select("agent", "id", "content").join(queries.select("agent", "query_id", "query"), "agent")
    return pairs.filter((F.col("query") != "") & F.ilike(F.col("content"), F.concat(F.lit("%"), F.col("query"), F.lit("%")))).select("query_id", "id")


def nearest_with_zeros(memories: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Nearest rows by vector and, after them with similarity 0, up to `limit` rows whose vector is zero, newest first.

    A query without signal (a zero vector) gets the newest rows instead.
    """
    pairs = live(memories).join(queries.select("agent", "query_id", "query_vec"), "agent")
    sim = F.when(is_zero(F.col("query_vec")) | is_zero(F.col("vec")), 0.0).otherwise(cosine(F.col("query_vec"), F.col("vec")))
    pairs = pairs.withColumn("similarity", sim).withColumn("_zero", is_zero(F.col("vec")) | is_zero(F.col("query_vec")))
    w = Window.partitionBy("query_id", "_zero").orderBy(F.col("similarity").desc(), F.when(F.col("_zero"), F.col("created_at")).desc(), F.when(F.col("_zero"), F.col("id")).desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "id", "similarity", F.col("_zero").alias("no_signal"), "rank")


def recent(df: DataFrame, limit: int = 20, *, category: str = "", include_invalid: bool = False, by: str = "agent") -> DataFrame:
    """The newest rows of each agent."""
    w = Window.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return matching(live(df, include_invalid), category=category).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return live(df).groupBy("agent", *by).agg(F.count(F.lit(1)).alias("n"))


def dimension_histogram(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """How many rows have vectors of which size; null means without one."""
    return df.groupBy(F.when(F.col(vec).isNotNull(), F.size(vec)).alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))
