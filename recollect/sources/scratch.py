"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Text rows that travel to Python in one Arrow batch; bounds a worker's memory with long texts.
ARROW_ROWS = 500


#: A table that is estimated at less than this a core is dealt over all cores before heavy work.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals a small table over all cores, as one of a single file or row group would be a single task.

    A large table is left as its files are split, so nothing is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="recollect-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/recollect-{uuid.uuid4().hex}"


_settings = threading.RLock()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) for the eager actions inside the block, of one thread at a time."""
    conf = {k.replace("__", "."): v for k, v in values.items()}
    with _settings:
        old = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors.

    Shuffle files of a write are removed when it ends, and a table that is no longer needed can be dropped, so the
    disk in use is that of one step. Tables that a returned DataFrame still reads are left to the cluster's clean-up
    of the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_dir(spark), {}

    def write(self, df: DataFrame, name: str, *, rows: int = ARROW_ROWS) -> DataFrame:
        path = f"{self.root}/{name}"
        conf = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true", "spark__sql__execution__arrow__maxRecordsPerBatch": str(rows)}
        with settings(self.spark, **conf):
            df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def write_parts(self, df: DataFrame, name: str, *by: str) -> str:
        """A table in a folder for each value of `by`, of one file each, for tasks that read folders; returns its path."""
        path = f"{self.root}/{name}"
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.repartition(*by).write.option("compression", "zstd").partitionBy(*by).parquet(path)
        self.paths[name] = path
        return path

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
