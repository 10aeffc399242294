"""The stored inverted-file index: changes, reloads, refusals, and what recall reads."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from recollect.agent import Agent
from recollect.operators import vectors as V
from recollect.operators.vector_index import StoredIndex


def _rows(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")


def _nearest(m: dict, q: np.ndarray, k: int) -> list:
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    return [i for _, i in sorted((-round(cos(q, v), 12), i) for i, v in m.items())[:k]]


def test_changes_are_seen_and_files_outlive_the_object(spark, tmp_path):
    r = np.random.default_rng(4)
    m = np.r_[r.normal(size=(12, 16))[r.integers(0, 12, 600)] + 0.2 * r.normal(size=(600, 16)), np.zeros((3, 16))]
    index = StoredIndex.build(_rows(spark, m), f"file://{tmp_path}/i", 16, source={"v": 1}, cells=24)
    new = r.normal(size=(20, 16))
    index = index.add(_rows(spark, new, 590), {"v": 2})  # ids 590..602 are replaced, 603..609 are new
    index = index.remove(spark.range(0, 50), {"v": 3})
    now = {i: v for i, v in enumerate(m) if 50 <= i < 590} | {590 + i: v for i, v in enumerate(new)}
    again = StoredIndex.load(spark, f"file://{tmp_path}/i", {"v": 3})
    assert {x.id for x in again.rows().collect()} == set(now) and again == index
    q = spark.createDataFrame([(0, m[60].tolist()), (1, new[3].tolist()), (2, [0.0] * 16)], "query_id long, query_vec array<double>")
    got: dict = {}
    for x in again.search(q, 7, probes=24).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    assert got == {0: _nearest(now, m[60], 7), 1: _nearest(now, new[3], 7), 2: _nearest(now, np.zeros(16), 7)}
    merged = again.merged()
    assert merged.state["gone"] == [] and {x.id for x in merged.rows().collect()} == set(now)
    assert merged.search(q, 0).count() == 0


def test_recall_and_rows_read_of_clustered_rows(spark, tmp_path):
    r = np.random.default_rng(6)
    m = r.normal(size=(150, 32))[r.integers(0, 150, 6000)] + 0.3 * r.normal(size=(6000, 32))
    df = _rows(spark, m)
    index = StoredIndex.build(df, f"file://{tmp_path}/r", 32)
    q = df.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    assert V.recall(spark, index.search(q, 10), V.create_index("exact", 32).search(q, df, 10)) >= 0.9
    assert index.reads(q).agg(F.avg("share")).first()[0] <= 0.1
    plan = index.rows([3, 4])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "PushedFilters: [In(cell, [3,4])" in plan or "In(cell" in plan


@pytest.mark.parametrize("bad", [[(1, [1.0])], [(1, [1.0, float("nan")])], [(1, [1.0, 2.0]), (1, [2.0, 1.0])], [(1, None)]])
def test_bad_vectors_are_refused(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        StoredIndex.build(spark.createDataFrame(bad, "id long, vec array<double>"), f"file://{tmp_path}/b", 2)


def test_stale_and_damaged_files_are_refused(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with pytest.raises(V.StaleIndexError):
        StoredIndex.load(spark, root)
    first = StoredIndex.build(_rows(spark, np.eye(4)), root, 4, source="a")
    with pytest.raises(V.StaleIndexError):
        StoredIndex.load(spark, root, "b")
    first.remove(spark.range(1), "b")
    with pytest.raises(V.StaleIndexError):  # it was made from a version that another writer has replaced
        first.remove(spark.range(2), "c")
    state = sorted(glob.glob(f"{tmp_path}/s/state/*.json"))[-1]
    open(state, "w").write("{")
    with pytest.raises(V.StaleIndexError):
        StoredIndex.load(spark, root)
    empty = StoredIndex.build(_rows(spark, np.zeros((0, 4))).limit(0), f"file://{tmp_path}/e", 4)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, query_vec array<double>")
    assert empty.search(q, 3).count() == 0


class Keywords:
    dimensions = 3

    def embed(self, df, key, text, out="embedding"):
        low = F.lower(F.col(text))
        v = F.when(low.contains("python"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(low.contains("mountain"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
        return df.withColumn(out, F.coalesce(v, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).cast("array<float>"))


def test_recall_reads_the_index_and_follows_changes(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/a"
    a = Agent(spark, "Ada", root, Keywords())
    python, mountain = a.remember(["Python is my language", "a walk in the mountains"])
    index = a.build_index()
    monkeypatch.setattr(a, "build_index", lambda *x, **y: pytest.fail("the index was built anew"))
    assert a.recall("python", limit=1).first()["id"] == python
    a.update(mountain, content="Python lives here too")
    a.forget(python)
    assert [x["id"] for x in a.recall("python", limit=5).collect()] == [mountain]
    b = Agent(spark, "Ada", root, Keywords())
    assert b.load_index().version == index.version + 1
    read: list = []
    monkeypatch.setattr(StoredIndex, "search", lambda self, *x, _f=StoredIndex.search, **y: read.append(self.version) or _f(self, *x, **y))
    assert [x["id"] for x in b.recall("python", limit=5).collect()] == [mountain] and read == [index.version + 1]
    os.remove(sorted(glob.glob(f"{tmp_path}/a/_index/*/state/*.json"))[-1])  # an older version is left, the rest follows from the log
    assert [x["id"] for x in b.recall("python", limit=5).collect()] == [mountain]
    b.store.compact("memories")
    with pytest.raises(V.StaleIndexError):
        b.load_index()
    assert [x["id"] for x in b.recall("python", limit=5).collect()] == [mountain]
