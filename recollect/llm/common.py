"""What the operators share: intermediate tables in the shared folder, and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import ARROW_ROWS, Scratch, settings, shared_dir

__all__ = ["ARROW_ROWS", "MAX_LONG", "Scratch", "keyed", "settings", "shared_dir", "table", "text_key"]

MAX_LONG = 2**63 - 1


def text_key(text: Column) -> Column:
    """64 bits of a text (null and empty differ); with a document id it names a row."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dk, th, doc_id, text): dk is doc_id with null last, th the text's hash; equal rows share both."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("dk"),
        text_key(F.col(text_col)).alias("th"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
