"""Pairs over a threshold: cells, copies and the vectors without length, against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from recollect.operators import graph as G
from recollect.operators import vectors as V


def _clustered(n: int, seed: int = 3) -> np.ndarray:
    """Twelve clusters, copies of a third of the rows' first, and some rows without length."""
    r = np.random.default_rng(seed)
    m = r.normal(size=(12, 24))[r.integers(0, 12, n)] + 0.35 * r.normal(size=(n, 24))
    m[:: n // 40] = m[0]
    m[5 :: n // 10] = 0
    return m


def _want(m: np.ndarray, groups: np.ndarray, threshold: float) -> dict:
    size = np.linalg.norm(m, axis=1)
    u = np.divide(m, size[:, None], out=np.zeros_like(m), where=size[:, None] > 0)
    s = u @ u.T
    return {(int(a), int(b)): s[a, b] for a, b in zip(*np.nonzero(np.triu(s >= threshold, 1)), strict=True) if groups[a] == groups[b]}


@pytest.mark.parametrize("threshold,block", [(0.9, 16), (0.7, 50), (0.95, 2048)])
def test_pairs_are_those_of_all_products(spark, threshold, block):
    m = _clustered(400)
    groups = np.arange(400) % 5 == 0  # one group of 80 rows, one of 320
    df = spark.createDataFrame([(int(i), str(groups[i]), v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>")
    got = {(r.a, r.b): r.similarity for r in V.similar_pairs(df, threshold, block=block).collect()}
    want = _want(m, groups, threshold)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    both = {(r.a, r.b) for r in V.similar_pairs(df, threshold, block=block, ordered=True).collect()}
    assert both == set(want) | {(b, a) for a, b in want}


def test_nearest_among_copies(spark):
    m = _clustered(300)
    groups = np.zeros(300)
    df = spark.createDataFrame([(int(i), "x", v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>")
    want: dict[int, list] = {}
    for (a, b), s in _want(m, groups, 0.8).items():
        want.setdefault(a, []).append((-round(s, 9), b))
        want.setdefault(b, []).append((-round(s, 9), a))
    got: dict[int, list] = {}
    for r in V.neighbours(df, 0.8, 4, block=30).collect():
        got.setdefault(r.a, []).append(-round(r.similarity, 9))
    assert {a: sorted(s for s, _ in v)[:4] for a, v in want.items()} == {a: sorted(v) for a, v in got.items()}


def test_rows_are_sent_only_where_they_may_match(spark, monkeypatch):
    """Of well-parted clusters a cell is compared with itself alone."""
    sent = []
    r = np.random.default_rng(1)
    m = np.eye(8)[np.arange(640) % 8] + 0.01 * r.normal(size=(640, 8))
    df = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>")
    cells = V.Cells.fit(df.selectExpr("id k", "vec v"), 8)
    assert len(cells.centres) == 8
    far = cells.angles(m / np.linalg.norm(m, axis=1, keepdims=True))
    radius = np.array([far[far.argmin(1) == c, c].max() for c in range(8)])
    sent = (far <= np.arccos(0.9) + radius).sum()
    assert sent == 640
    assert V.similar_pairs(df, 0.9, block=100).count() == 8 * 80 * 79 // 2


def test_empty_and_short(spark):
    none = spark.createDataFrame([], "id long, agent string, vec array<double>")
    assert V.similar_pairs(none, 0.5).count() == 0
    odd = spark.createDataFrame([(1, "x", None), (2, "x", [1.0]), (3, "x", [1.0, 0.0]), (4, "x", [2.0, 0.0, 0.0]), (5, None, [1.0, 0.0])], "id long, agent string, vec array<double>")
    assert [(r.a, r.b) for r in V.similar_pairs(odd, 0.5).collect()] == [(3, 4)]


def test_a_large_group_is_stored_once_and_read_block_by_block(spark, monkeypatch):
    """No row is shuffled once a block: what is written for the comparison has each row once."""
    m = _clustered(500, 9)
    df = spark.createDataFrame([(int(i), "x", v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>")
    written: list = []
    keep = V.Scratch.write_parts
    monkeypatch.setattr(V.Scratch, "write_parts", lambda self, rows, name, *by: written.append(rows.count()) or keep(self, rows, name, *by))
    pairs = V.similar_pairs(df, 0.7, block=40)
    assert {(r.a, r.b) for r in pairs.collect()} == set(_want(m, np.zeros(500), 0.7))
    assert len(written) == 1 and written[0] <= 500


def test_neighbours_of_copies_share_a_list(spark):
    """Ten copies each of some vectors: of each row the nearest by similarity and id, its own copies first."""
    r = np.random.default_rng(8)
    m = np.repeat(np.round(r.normal(size=(20, 6)) * 4), 10, axis=0)
    df = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    for limit, block in ((4, 2048), (15, 7)):
        got: dict = {}
        for x in V.neighbours(df, 0.3, limit, block=block).orderBy("a", "rank").collect():
            got.setdefault(x.a, []).append(x.b)
        assert got == {a: [b for _, b in sorted((-s[a, b], b) for b in range(200) if b != a and s[a, b] >= 0.3)[:limit]] for a in range(200)}


def test_conflicts_carry_no_texts(spark):
    rows = [(1, "x", "we never go", "fact", [1.0, 0.0]), (2, "x", "we go", "fact", [1.0, 0.1]), (3, "x", None, "correction", [1.0, 0.2]), (4, "x", "we go", None, [1.0, 0.05])]
    df = spark.createDataFrame(rows, "id long, agent string, content string, category string, vec array<double>").withColumn("invalid_at", F.lit(None).cast("timestamp"))
    out = G.semantic_conflicts(df)
    got = {(r.memory_id_a, r.memory_id_b): r.signal for r in out.collect()}
    assert got == {(1, 2): "never", (1, 4): "never", (1, 3): "correction_category", (2, 3): "correction_category", (3, 4): "correction_category"}
    assert "content" not in out._jdf.queryExecution().optimizedPlan().toString()
