"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors; needed on a cluster where it is not installed, as Arrow operators import it there."""
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="recollect-", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for x in sorted(root.rglob("*.py")):
                z.write(x, x.relative_to(root.parent))
    spark.sparkContext.addPyFile(f.name)


def session(app: str = "recollect", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword settings (dots written as __) come on top."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        ship(spark)
    return spark
