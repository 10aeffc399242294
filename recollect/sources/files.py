"""Small files in any file system that Spark reaches."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    s = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
    finally:
        s.close()


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside `path` and renames, so a reader sees the old text or the new one."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not move {tmp} to {path}")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes `path` whole unless it is there; of several writers at once one succeeds, the others get False."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    jvm = spark._jvm
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":  # Java's rename replaces, a link does not
            own, target = (unquote(urlparse(x.toUri().toString()).path) for x in (tmp, p))
            os.link(own, target)
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(p):
            return False
        raise
    finally:
        fs.delete(tmp, False)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds, sorted; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_folder(uri: str, columns: list[str]) -> pa.Table:
    """The Parquet files of a folder that all tasks reach, read in a task through Arrow's file systems."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
    tables = []
    for f in files:
        with system.open_input_file(f) as source:
            tables.append(pq.ParquetFile(source).read(columns=columns))
    return pa.concat_tables(tables)


def is_digest(text: str | None) -> bool:
    """Whether a text is a SHA-256 in lower-case hex."""
    return text is not None and len(text) == 64 and not set(text) - set("0123456789abcdef")


def file_digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file's bytes, read in pieces."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
