"""Table schemas, defaults of absent values, and the contract that a stored table must meet."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VEC = T.ArrayType(T.FloatType())


def _t(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in cols])


L, S, I, D, B, TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()  # noqa: E741
SCORES = T.MapType(S, D)
TABLES: dict[str, T.StructType] = {
    "memories": _t(
        ("id", L, False), ("agent", S, False), ("category", S, False), ("content", S, False), ("embedding", _VEC, True), ("importance", I, False), ("valence", D, True), ("arousal", D, True), ("dominance", D, True),
        ("source", S, True), ("scope", S, True), ("confidence_score", D, True), ("utility_score", D, True), ("relevance_score", D, True), ("last_activation", TS, True), ("identity_defining", B, True), ("event_time", TS, True),
        ("episode_context", S, True), ("metadata", S, True), ("valid_from", TS, True), ("invalid_at", TS, True), ("created_at", TS, False),
    ),
    "identity": _t(("agent", S, False), ("personality", S, True), ("boot_context", S, True), ("philosophy", S, True), ("ocean_scores", SCORES, True), ("ocean_baseline", SCORES, True), ("updated_at", TS, True)),
    "relationships": _t(("id", L, False), ("agent", S, False), ("person", S, False), ("trust_level", D, True), ("style", S, True), ("dynamic", S, True), ("updated_at", TS, True)),
    "rules": _t(("id", L, False), ("agent", S, False), ("rule_key", S, False), ("content", S, True), ("set_by", S, True), ("priority", S, True), ("active", B, True), ("created_at", TS, True)),
    "inner_monologue": _t(("id", L, False), ("agent", S, False), ("session_id", S, True), ("turn_number", I, True), ("thought", S, True), ("emotional_state", S, True), ("created_at", TS, True)),
    "diary": _t(("id", L, False), ("agent", S, False), ("mood", S, True), ("content", S, True), ("session_date", T.DateType(), True), ("created_at", TS, True)),
    "instincts": _t(("id", L, False), ("agent", S, False), ("trigger_pattern", S, True), ("action", S, True), ("confidence", D, True), ("activation_count", I, True), ("last_activated", TS, True), ("created_at", TS, True)),
    "working_state": _t(("agent", S, False), ("state", S, True), ("updated_at", TS, True), ("turn_count", I, True)),
    "procedural_memories": _t(
        ("id", L, False), ("agent", S, False), ("task_type", S, True), ("task_description", S, True), ("workflow", S, True), ("facts", S, True), ("embedding", _VEC, True), ("hit_count", I, True), ("success_count", I, True),
        ("fail_count", I, True), ("source_task", S, True), ("build_policy", S, True), ("reflection", S, True), ("created_at", TS, True), ("updated_at", TS, True),
    ),
    "edges": _t(("agent", S, False), ("src", L, False), ("dst", L, False), ("type", S, False), ("weight", D, True)),
    "mentions": _t(("agent", S, False), ("memory_id", L, False), ("entity", S, False), ("entity_type", S, True)),
}
KEYS = {"memories": ["id"], "identity": ["agent"], "relationships": ["agent", "person"], "rules": ["agent", "rule_key"], "instincts": ["id"], "working_state": ["agent"], "procedural_memories": ["id"], "inner_monologue": ["id"], "diary": ["id"], "edges": ["agent", "src", "dst", "type"], "mentions": ["agent", "memory_id", "entity"]}
#: Values of columns that an insert leaves out (fixed by the data model).
DEFAULTS: dict[str, dict[str, object]] = {
    "memories": {"category": "fact", "importance": 5, "valence": 0.0, "arousal": 0.0, "dominance": 0.0, "source": "conversation", "scope": "private", "confidence_score": 1.0, "utility_score": 0.5, "relevance_score": 1.0, "identity_defining": False, "metadata": "{}"},
    "identity": {"personality": "", "boot_context": "", "philosophy": ""},
    "relationships": {"trust_level": 0.5, "style": "default", "dynamic": ""},
    "rules": {"set_by": "system", "priority": "normal", "active": True},
    "inner_monologue": {"session_id": "", "turn_number": 0, "emotional_state": ""},
    "diary": {},
    "instincts": {"confidence": 0.5, "activation_count": 0},
    "working_state": {"state": "{}", "turn_count": 0},
    "procedural_memories": {"task_type": "general", "hit_count": 0, "success_count": 0, "fail_count": 0, "build_policy": "direct"},
}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """`df` in the table's schema: columns left out or null take their defaults, malformed metadata becomes {}."""
    d = DEFAULTS.get(table, {})
    cols = []
    for f in TABLES[table].fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in ("metadata", "state"):
            c = F.when(F.get_json_object(c, "$").isNotNull(), c)
        cols.append((F.coalesce(c, F.lit(d[f.name]).cast(f.dataType)) if f.name in d else c).alias(f.name))
    return df.select(*cols)


def schema_digest(schema: T.StructType) -> str:
    """SHA-256 of the columns' names, types and nullability."""
    return hashlib.sha256("\n".join(f"{f.name}:{f.dataType.simpleString()}:{f.nullable}" for f in schema.fields).encode()).hexdigest()


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)], "ordinal int, column string, type string")


def contract_diff(spark: SparkSession, actual: T.StructType, expected: T.StructType) -> DataFrame:
    """(problem, column, type): columns that the contract has and the table lacks, and the reverse; a changed type is both."""
    a, e = (schema_rows(spark, s).select("column", "type") for s in (actual, expected))
    missing, extra = e.exceptAll(a), a.exceptAll(e)
    return missing.select(F.lit("missing").alias("problem"), "column", "type").unionByName(extra.select(F.lit("unexpected").alias("problem"), "column", "type"))


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Key values that break the table's uniqueness."""
    return df.groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_contract(df: DataFrame, table: str, dimensions: int | None = None) -> None:
    """Raises RuntimeError unless schema, keys and vector sizes are as the contract says."""
    spark = df.sparkSession
    if bad := contract_diff(spark, df.schema, TABLES[table]).take(5):
        raise RuntimeError(f"{table}: schema differs: {[tuple(r) for r in bad]}")
    if table in KEYS and not duplicate_keys(df, table).isEmpty():
        raise RuntimeError(f"{table}: repeated keys")
    if dimensions and "embedding" in df.columns and not df.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dimensions)).isEmpty():
        raise RuntimeError(f"{table}: vectors of other than {dimensions} dimensions")


def contract_breaks(df: DataFrame, table: str, dimensions: int | None = None) -> DataFrame:
    """(problem, column, n): how many rows break the table's rules: nulls where none may be, rows that repeat a key, vectors of another size."""
    need = [f.name for f in TABLES[table].fields if not f.nullable and f.name in df.columns]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in need]).select(F.explode(F.array(*[F.struct(F.lit("null").alias("problem"), F.lit(c).alias("column"), F.col(c).alias("n")) for c in need])).alias("x")).select("x.*")
    out = nulls.unionByName(duplicate_keys(df, table).agg(F.lit("repeated key").alias("problem"), F.lit(",".join(KEYS[table])).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    if dimensions and "embedding" in df.columns:
        out = out.unionByName(df.agg(F.lit("dimensions").alias("problem"), F.lit("embedding").alias("column"), F.count_if(F.size("embedding") != dimensions).alias("n")))
    return out.filter("n > 0")
