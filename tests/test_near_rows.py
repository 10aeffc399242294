"""Nearest rows and their counts: how little is compared for them, against all products."""

import numpy as np
from pyspark.sql import functions as F
from recollect.operators import graph as G
from recollect.operators import vectors as V


def _voices(n: int, seed: int = 5) -> np.ndarray:
    """Unit rows that lie along one of four directions, some more so than others, and at random otherwise."""
    r = np.random.default_rng(seed)
    noise = r.normal(size=(n, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    m = np.eye(4, 64)[r.integers(0, 4, n)] + r.uniform(0.05, 1.5, (n, 1)) * noise
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _side(m: np.ndarray, ids: np.ndarray, stands: np.ndarray | None = None) -> V._Side:
    return V._Side(ids, m, m.astype(np.float32), np.ones(len(m), np.int64) if stands is None else stands)


def _frame(spark, m: np.ndarray, agent: str = "x"):
    return spark.createDataFrame([(i, agent, v.tolist()) for i, v in enumerate(m)], "id long, agent string, vec array<double>").withColumn("invalid_at", F.lit(None).cast("timestamp"))


def test_cells_along_few_axes_let_most_pairs_go(spark):
    """Cells of whole rows are so wide that nearly every pair is within reach; what is let go never holds a pair."""
    m, reach = _voices(3000), float(V._angle(0.7))
    cells = V.Cells.apart(_frame(spark, m).selectExpr("id k", "vec v"), 40, reach)
    assert cells.axes is not None
    assert cells.left(m, reach) < 0.8 * V.Cells.among(m, 40).left(m, reach)
    far, own = cells.angles(m), cells.own(m)
    radius = np.array([far[own == c, c].max(initial=0) for c in range(len(cells.centres))])
    a, b = np.nonzero(m @ m.T >= 0.7)
    assert (far[a, own[b]] <= reach + radius[own[b]]).all()


def test_best_of_pieces_are_those_of_all_products():
    """Rows that differ by less than singles tell apart are ranked by doubles, in whatever order pieces come."""
    m, r = _voices(900, 6), np.random.default_rng(2)
    m[100:200] = m[:100] + 1e-8 * r.normal(size=(100, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 12)
    want = {a: sorted((-s[a, b], b) for b in range(900) if b != a and s[a, b] >= 0.7)[:5] for a in range(300)}
    f = V._BestPairs(_side(m[:300], np.arange(300)), 0.7, 5)
    list(f.add(np.arange(300), None))
    for at in (600, 300):
        needed = f.needed()
        list(f.add(np.arange(300), _side(m[at : at + 300], np.arange(at, at + 300))))
        assert (f.needed() >= needed).all()
    got: dict = {a: [] for a in want}
    for a, b, x in zip(*next(f.result()), strict=True):
        got[int(a)].append((-round(float(x), 12), int(b)))
    assert {a: [b for _, b in v] for a, v in want.items()} == {a: [b for _, b in sorted(v)] for a, v in got.items()}


def test_rows_with_enough_are_not_compared_again():
    m = np.array([[1.0, 0.0], [0.9, np.sqrt(0.19)], [0.0, 1.0], [-1.0, 0.0]])
    f = V._Counts(_side(m, np.arange(4), np.array([1, 1, 4, 1])), 0.7, 3)
    list(f.add(np.arange(4), None))
    assert f.n.tolist() == [1, 1, 3, 0]
    assert (f.needed() < np.inf).tolist() == [True, True, False, True]
    # 0.7 of row 0 exactly, as doubles have it.
    list(f.add(np.array([0, 1, 3]), _side(np.array([[0.7, -np.sqrt(0.51)]]), np.array([9]), np.array([5]))))
    assert next(f.result())[1].tolist() == [3, 1, 3, 0]


def test_counts_are_those_of_the_neighbours(spark):
    m = np.round(_voices(500, 7) * 3)  # whole numbers, so that some rows are equal and some without length
    m[:60] = m[0]
    for block in (2048, 30):
        df = _frame(spark, m)
        near = {(r.agent, r.a): r["count"] for r in V.neighbours(df, 0.7, 6, block=block).groupBy("agent", "a").count().collect()}
        got = {(r.agent, r.a): r.n for r in V.neighbour_counts(df, 0.7, 6, block=block).collect()}
        assert {k: n for k, n in got.items() if n} == near and len(near) > 100
        assert G.edge_counts(df, 0.7, 6).first().edges == sum(near.values())
