"""Re-embedding of stored vectors: plan, resumable run by id ranges, verification and rollback."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_text, write_atomic
from .integrity import block_fingerprint

#: The columns whose text is embedded, by table (fixed by the data model).
TEXT_COLUMNS = {"memories": ["content"], "procedural_memories": ["task_description", "workflow"]}
BATCH = 256


def plan(df: DataFrame, source: int = 128, target: int = 1024, batch: int = BATCH) -> DataFrame:
    """Counts of what a migration from `source` to `target` dimensions would do; one row."""
    size = F.size("embedding")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("embedding").isNotNull()).alias("n_vectors"), F.lit(source).alias("source_dimensions"), F.lit(target).alias("target_dimensions"),
        F.count_if(F.col("embedding").isNotNull() & (size != source)).alias("n_unexpected"), F.ceil(F.count(F.lit(1)) / F.lit(float(batch))).cast("long").alias("n_batches"),
    )


def migrate(spark: SparkSession, source: str, candidate: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], *, table: str = "memories", target: int = 1024, ranges: int = 16, resume: bool = False, max_ranges: int | None = None, dry_run: bool = False) -> dict:
    """Writes `source` (Parquet) to `candidate` with new vectors, range of ids by range; each finished range is noted in
    `checkpoint`, so a run that stops goes on with `resume`. The source is never written.

    `embed` gets (id, _text) and returns (id, embedding). Vectors must be `target` finite numbers, the other columns
    and the source's fingerprint must be unchanged at the end.
    """
    if len({source, candidate, checkpoint}) < 3:
        raise ValueError("source, candidate and checkpoint must differ")
    df = spark.read.parquet(source)
    kept = [c for c in df.columns if c != "embedding"]
    mark = block_fingerprint(df, "id", kept).first()["fingerprint"]
    state = json.loads(read_text(spark, checkpoint) or "null") if resume else None
    if resume and state is None:
        raise ValueError("there is no checkpoint to resume from")
    if state and (state["source"], state["target"], state["mark"], state["ranges"]) != (source, target, mark, ranges):
        raise ValueError("the checkpoint belongs to another source or target")
    state = state or {"source": source, "target": target, "mark": mark, "ranges": ranges, "done": [], "status": "running"}
    if dry_run:
        return state | {"status": "planned"}
    low, high = df.agg(F.min("id"), F.max("id")).first()
    width = ((high or 0) - (low or 0)) // ranges + 1
    for i in [i for i in range(ranges) if i not in state["done"]][:max_ranges]:
        part = df.filter((F.col("id") >= (low or 0) + i * width) & (F.col("id") < (low or 0) + (i + 1) * width))
        new = embed(part.select("id", F.concat_ws(" ", *TEXT_COLUMNS[table]).alias("_text")))
        part.drop("embedding").join(new, "id").select(*df.columns).write.mode("overwrite").parquet(f"{candidate}/range={i}")
        state["done"].append(i)
        write_atomic(spark, checkpoint, json.dumps(state))
    if len(state["done"]) == ranges:
        out = spark.read.parquet(*[f"{candidate}/range={i}" for i in range(ranges)])
        bad = out.filter(F.col("embedding").isNull() | (F.size("embedding") != target) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).count()
        if bad or out.count() != df.count() or block_fingerprint(out, "id", kept).first()["fingerprint"] != mark or block_fingerprint(spark.read.parquet(source), "id", kept).first()["fingerprint"] != mark:
            raise RuntimeError("verification failed: vectors are malformed or other columns changed")
        state["status"] = "complete"
        write_atomic(spark, checkpoint, json.dumps(state))
    return state


def rollback(spark: SparkSession, checkpoint: str) -> dict:
    """Marks a migration as rolled back; the candidate stays as evidence. Repeating it changes nothing."""
    state = json.loads(read_text(spark, checkpoint) or "null")
    if not state:
        raise ValueError("there is no checkpoint")
    if state["status"] != "rolled_back":
        state["status"] = "rolled_back"
        write_atomic(spark, checkpoint, json.dumps(state))
    return state
