"""Embedding and language providers, and readers of tables kept elsewhere."""

from __future__ import annotations

import contextlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import text as X


class Embedder(Protocol):
    dimensions: int

    def embed(self, df: DataFrame, key: str, text: str, out: str) -> DataFrame: ...


class HashEmbedder:
    """Deterministic and lexical; all in built-in expressions."""

    def __init__(self, dimensions: int = X.DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, df: DataFrame, key: str, text: str, out: str = "embedding") -> DataFrame:
        counts = X.hash_embed(df, key, text, "_counts", self.dimensions)
        return counts.withColumn(out, X.normalised(F.col("_counts"))).drop("_counts")


class ModelEmbedder:
    """Any model by an Arrow UDF: `load` runs once a worker and returns texts -> array of vectors, which are checked."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimensions: int, batch: int = 32):
        self.load, self.dimensions, self.batch = load, dimensions, batch

    def column(self, text: Column) -> Column:
        load, dims, size = self.load, self.dimensions, self.batch

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                out: list[np.ndarray] = []
                for i in range(0, len(s), size):
                    part = s.iloc[i : i + size].fillna("").tolist()
                    v = np.asarray(model(part), np.float32)
                    if v.shape != (len(part), dims) or not np.isfinite(v).all():
                        raise ValueError(f"the model gave {v.shape}, not {(len(part), dims)} finite numbers")
                    out.extend(v)
                yield pd.Series(out)

        return run(text)

    def embed(self, df: DataFrame, key: str, text: str, out: str = "embedding") -> DataFrame:
        return df.withColumn(out, self.column(F.col(text)))


def loopback(url: str) -> str:
    """The URL without a trailing slash, if it is plain HTTP to this machine without user, query or fragment."""
    u = urlparse(url)
    if u.scheme not in ("http", "https") or u.hostname not in ("localhost", "127.0.0.1", "::1") or u.username or u.query or u.fragment:
        raise ValueError("only a local address is allowed")
    return url.rstrip("/")


def local_server(url: str, model: str, timeout: float = 60) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A loader for ModelEmbedder that posts texts to a local embedding server; redirects are refused."""
    base = loopback(url)

    class NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            raise ValueError("redirects are refused")

    def load() -> Callable[[list[str]], np.ndarray]:
        opener = urllib.request.build_opener(NoRedirect, urllib.request.ProxyHandler({}))

        def call(texts: list[str]) -> np.ndarray:
            req = urllib.request.Request(f"{base}/api/embed", json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
            with opener.open(req, timeout=timeout) as r:
                return np.asarray(json.load(r)["embeddings"], np.float32)

        return call

    return load


class StubLanguageModel:
    def generate(self, prompt: str) -> str:
        return ""


class ServerLanguageModel:
    """Text from a local server."""

    def __init__(self, url: str, model: str, timeout: float = 60):
        self.url, self.model, self.timeout = loopback(url), model, timeout

    def generate(self, prompt: str) -> str:
        req = urllib.request.Request(f"{self.url}/api/generate", json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            return json.load(r).get("response", "")


class SourceError(RuntimeError):
    """A foreign table could not be read or written; says what failed, but nothing of addresses, users or values."""


@contextlib.contextmanager
def redacted(action: str) -> Iterator[None]:
    """Errors inside the block come out as a SourceError with their class alone, without the message or a chain."""
    try:
        yield
    except SourceError:
        raise
    except Exception as e:
        found = re.search(r"\b(?:\w+\.)*(\w+(?:Exception|Error))\b", str(e))  # the JVM's own, if Spark wraps it
        raise SourceError(f"{action} failed: {type(e).__name__}{f' ({found[1]})' if found else ''}") from None


def identifier(name: str) -> str:
    """A table's or column's name, as schema.table too, if it is plain: letters, digits and underscores, no leading digit."""
    if not re.fullmatch(r"[A-Za-z_]\w{0,62}(\.[A-Za-z_]\w{0,62})?", name, re.A):
        raise ValueError(f"{name!r} is not a plain identifier")
    return name


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str = "id", low: int = 0, high: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read in `parts` ranges of its key when bounds are given."""
    with redacted("reading"):
        r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        return (r.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts) if high > low else r).load()


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", batch: int = 5_000, parts: int = 16, **options: str) -> None:
    """Writes rows over JDBC by at most `parts` connections; vectors go as text in brackets, as vector columns take them.

    Table and columns must be plain identifiers, as they become part of statements.
    """
    for name in (table, *df.columns):
        identifier(name)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    out = df.withColumns({c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ","), F.lit("]")) for c in arrays})
    with redacted("writing"):
        out.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()


def unpack_vectors(blob: Column) -> Column:
    """Little-endian float32 blobs, as foreign tables keep vectors, as arrays."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return run(blob)


def pack_vectors(vec: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vec)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, *, ranges: int = 16) -> DataFrame:
    """A SQLite table by ranges of rowid, each read by one task; the file must be on a path that executors share."""
    names = [c.name for c in spark.createDataFrame([], schema).schema.fields]
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    step = ((high or 0) - (low or 0)) // ranges + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cols = ",".join(f'"{n}"' for n in names)
                    yield pd.read_sql_query(f'SELECT {cols} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', db, params=(int(start), int(start) + step))

    return spark.range(low or 0, (low or 0) + ranges * step, step, ranges).mapInPandas(run, schema)
