"""Structured Streaming: windows of activity, an ingest log folded into the current state, routing of new memories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import consolidation as C
from ..sources.providers import Embedder
from ..sources.scratch import Scratch
from ..sources.store import Store


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming else e


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(event_type, window_start, n, total) by tumbling or sliding windows; as a stream, events later than `late` are dropped."""
    e = _timed(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_start"), "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = _timed(events, late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def instinct_state(activations: DataFrame) -> DataFrame:
    """(id, confidence, activations) kept by key: each activation closes a tenth of the gap to 1, rounded to 4 places.

    activations have (id, confidence as it was before the first one).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c, n = state.get if state.exists else (None, 0)
        for b in batches:
            for start in b["confidence"]:
                c = round(min(1.0, (start if c is None else c) + 0.1 * (1 - (start if c is None else c))), 4)
                n += 1
        state.update((c, n))
        yield pd.DataFrame([(key[0], c, n)], columns=["id", "confidence", "activations"])

    schema = "id long, confidence double, activations long"
    return activations.groupBy("id").applyInPandasWithState(step, schema, "confidence double, activations long", "update", GroupStateTimeout.NoTimeout)


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True):
    """Runs `apply(batch, batch_id)` on each micro-batch; give it idempotent work, as a failed batch is repeated."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def store_sink(store: Store, table: str, name: str) -> Callable[[DataFrame, int], None]:
    """Takes each micro-batch of a stream into a table of the store exactly once.

    The number of the last batch of the stream `name` is part of the table's state and is written by the same commit as
    the rows; a batch that is repeated after a failure, whether it had been committed or not, changes nothing more.
    """
    return lambda batch, number: None if batch.isEmpty() else store.append(table, batch, done=(name, number))


def into_store(stream: DataFrame, store: Store, table: str, name: str, checkpoint: str, *, once: bool = True):
    """Starts a query that writes the stream's rows (business columns, key included) to a table exactly once."""
    return apply_batches(stream, store_sink(store, table, name), checkpoint, once=once)


def routed(store: Store, embedder: Embedder, name: str) -> Callable[[DataFrame, int], None]:
    """As `store_sink` for memories (id, agent, content, utility_score): each batch is embedded and routed by what its
    agent's newest memories hold; what takes the fast path is stored at half the importance, all exactly once."""

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        scratch = Scratch(batch.sparkSession)
        new = scratch.write(embedder.embed(batch, "id", "content", "embedding"), "batch")
        asked = new.select("agent", F.col("id").alias("cand_id"), F.col("embedding").alias("vec"), F.coalesce("utility_score", F.lit(0.5)).alias("utility"))
        way = C.route(asked, store.current("memories").withColumnRenamed("embedding", "vec")).select(F.col("cand_id").alias("id"), (F.col("route") == "fast_path").alias("_fast"))
        importance = F.coalesce(F.col("importance"), F.lit(5)) if "importance" in new.columns else F.lit(5)
        out = new.join(way, "id").withColumn("importance", F.when(F.col("_fast"), F.ceil(importance / 2)).otherwise(importance).cast("int")).drop("_fast")
        store.append("memories", out, done=(name, number))

    return apply
