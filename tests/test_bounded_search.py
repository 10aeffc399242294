"""Searches whose memory and shuffles do not grow with the table."""

import numpy as np
from pyspark.sql import functions as F
from recollect.operators import vectors as V
from recollect.operators.vector_index import StoredIndex


def _rows(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")


def test_nearest_keeps_k_whatever_the_pieces():
    r = np.random.default_rng(2)
    sim = np.round(r.random((7, 500)), 2)  # many ties
    best = V.Nearest(7, 5)
    for at in range(0, 500, 60):
        best.add(np.arange(7), np.arange(500)[at : at + 60], sim[:, at : at + 60])
        assert len(best.q) <= 7 * 5
    want = [(q, i) for q in range(7) for _, i in sorted((-s, i) for i, s in enumerate(sim[q]))[:5]]
    assert list(zip(best.q.tolist(), best.id.tolist(), strict=True)) == want


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(V, "CELLS", 64)
    cells = V.Cells(np.eye(8))
    m = np.random.default_rng(3).normal(size=(50, 8))
    assert max(x.size for x in cells.pieces(m)) <= 64 and (cells.own(m) == cells.angles(m).argmin(axis=1)).all()


def test_hyperplane_search_is_that_of_its_candidates_without_a_join(spark):
    m = np.random.default_rng(5).normal(size=(600, 16))
    base = _rows(spark, m)
    q = base.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    for index in (V.create_index("lsh", 16), V.LshIndex.for_rows(16, 600)):
        found = index.search(q, base, 10)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        full = index.candidates(q, base).join(q, "query_id").join(base, "id").withColumn("s", V.cosine(F.col("query_vec"), F.col("vec"))).collect()
        want: dict = {}
        for x in full:
            want.setdefault(x.query_id, []).append((-round(x.s, 12), x.id))
        got: dict = {}
        for x in found.orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.id)
        assert got == {k: [i for _, i in sorted(v)[:10]] for k, v in want.items()}


def test_index_search_sends_no_query_once_a_cell(spark, tmp_path):
    m = np.random.default_rng(6).normal(size=(900, 16))
    m[3] = 0
    index = StoredIndex.build(_rows(spark, m), f"file://{tmp_path}/i", 16, cells=30)
    q = _rows(spark, m).filter("id % 100 = 3").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    for probes in (4, 30):
        found = index.search(q, 5, probes=probes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Join" not in plan
        cell = {r.id: r.cell for r in index.rows().collect()}
        probed: dict = {}
        for r in index.probed(q, probes).collect():
            probed.setdefault(r.query_id, set()).add(r.cell)
        u = np.divide(m, (n := np.linalg.norm(m, axis=1, keepdims=True)), out=np.zeros_like(m), where=n > 0)
        for i, cells in probed.items():
            want = sorted((-round(float(u[i] @ u[j]), 12), j) for j in range(900) if cell[j] in cells)[:5]
            assert [r.id for r in found.filter(F.col("query_id") == i).orderBy("rank").collect()] == [j for _, j in want]
