"""The driver's tables as the engine's tables: one deterministic rule each, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import Scratch

CATEGORIES = ("fact", "emotion", "humor", "dynamic", "pattern", "insight", "preference", "decision", "trust", "correction", "milestone")
#: 2026-07-01 and 2025-01-01, UTC.
AS_OF, START = 1_782_864_000, 1_735_689_600


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    frac = lambda a, m: ((i * a) % m).cast("double") / 100
    return table(spark, sf, "documents").select(
        i.alias("id"), F.col("source").alias("agent"), F.col("text").alias("content"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 11 + 1).cast("int")).alias("category"),
        (i % 10 + 1).cast("int").alias("importance"), (((i * 37) % 201 - 100).cast("double") / 100).alias("valence"), frac(53, 101).alias("arousal"), frac(17, 101).alias("utility_score"),
        frac(29, 101).alias("confidence_score"), frac(13, 101).alias("relevance_score"), F.timestamp_seconds(F.lit(START) + (i % 500) * 86_400).alias("created_at"),
        F.when(i % 3 != 0, F.timestamp_seconds(F.lit(AS_OF) - (i % 40) * 43_200)).alias("last_activation"), (i % 50 == 0).alias("identity_defining"),
        F.when(i % 17 == 0, F.timestamp_seconds(F.lit(AS_OF))).alias("invalid_at"), F.when(i % 2 == 0, "private").otherwise("shared").alias("scope"),
    )


#: The same as a common table expression; times are seconds since 1970.
MEM = """mem AS (
  SELECT doc_id AS id, source AS agent, text AS content,
    (['fact','emotion','humor','dynamic','pattern','insight','preference','decision','trust','correction','milestone'])[CAST(doc_id % 11 + 1 AS INTEGER)] AS category,
    CAST(doc_id % 10 + 1 AS INTEGER) AS importance, CAST((doc_id * 37) % 201 - 100 AS DOUBLE) / 100 AS valence, CAST((doc_id * 53) % 101 AS DOUBLE) / 100 AS arousal,
    CAST((doc_id * 17) % 101 AS DOUBLE) / 100 AS utility_score, CAST((doc_id * 29) % 101 AS DOUBLE) / 100 AS confidence_score, CAST((doc_id * 13) % 101 AS DOUBLE) / 100 AS relevance_score,
    1735689600 + (doc_id % 500) * 86400 AS created_at, CASE WHEN doc_id % 3 <> 0 THEN 1782864000 - (doc_id % 40) * 43200 END AS last_activation,
    doc_id % 50 = 0 AS identity_defining, CASE WHEN doc_id % 17 = 0 THEN 1782864000 END AS invalid_at, CASE WHEN doc_id % 2 = 0 THEN 'private' ELSE 'shared' END AS scope
  FROM documents)"""


def hash_sql(name: str, source: str, key: str, text: str) -> str:
    """Expressions {name}_c (key, bucket, n) and {name}_n (key, norm) of the hash embeddings of a table's texts."""
    return rf"""{name}_w AS (SELECT {key} AS key, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}),
{name}_t AS (SELECT key, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]) ELSE CAST([] AS VARCHAR[]) END)) AS t FROM {name}_w),
{name}_c AS (SELECT key, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128 AS INTEGER) AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS n FROM {name}_t GROUP BY ALL HAVING n <> 0),
{name}_n AS (SELECT key, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM {name}_c GROUP BY key)"""


def row_sql(*columns: str) -> str:
    """The text of a row that its hash is made of: each column's length in bytes, a colon and the column, or a hyphen for null."""
    return " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns)


def embedded(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """The table with its vectors, stored, so that a query that reads them several times computes them once."""
    return Scratch(df.sparkSession).write(X.hash_embed(df, key, text, "vec"), "embedded")


def asked(spark: SparkSession, sf: str, per_agent: int = 20) -> DataFrame:
    """Every benchmark item as a question to one agent."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % per_agent).cast("string")).alias("agent"), F.col("text").alias("query"))


def queries(spark: SparkSession, sf: str, per_agent: int = 20) -> DataFrame:
    """The questions with their vectors."""
    return embedded(asked(spark, sf, per_agent), "query_id", "query").withColumnRenamed("vec", "query_vec")


QUERIES_SQL = "qry AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS agent, text AS query FROM benchmark)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table: the label is the agent; every 25th vector is made zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("agent"), F.when(F.col("vec_id") % 25 == 7, zero).otherwise(v).alias("vec"), F.timestamp_seconds(F.lit(START) + F.col("vec_id") * 60).alias("created_at"), F.lit(None).cast("timestamp").alias("invalid_at"))


VEC = "vec AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS agent, CASE WHEN vec_id % 25 = 7 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE)) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings)"
COS = "CASE WHEN list_sum(list_transform({a}, lambda x: abs(x))) = 0 OR list_sum(list_transform({b}, lambda x: abs(x))) = 0 THEN 0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
