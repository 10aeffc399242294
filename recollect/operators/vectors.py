"""Vector operators: cosine, exact and approximate k nearest, similar pairs in blocks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import read_folder
from ..sources.scratch import Scratch
from .blocks import BROADCAST_ROWS, per_block

#: Rows of one block of a pairwise comparison.
BLOCK = 2048
#: Entries of one matrix product; bounds the memory of a task.
CELLS = 2_000_000
#: Pairs whose products are taken again in doubles at once.
PAIRS = 16_384
#: Whole numbers by column for unit rows: (rows, columns), or (rows, columns, probes) if they ask.
Codes = Callable[[np.ndarray, bool], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays, 0 if either has no length; a longer array's rest counts in its norm only.

    Norms that were computed once a row, before rows were paired, save two thirds of the work.
    """
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), length), F.lit(0.0))


def clamp_similarity(distance: Column) -> Column:
    return F.least(F.greatest(1 - distance, F.lit(-1.0)), F.lit(1.0))


def usable(vec: Column, least: int = 2) -> Column:
    return F.coalesce(F.size(vec) >= least, F.lit(False))


def is_zero(vec: Column) -> Column:
    return ~F.exists(vec, lambda x: x != 0)


def check_vectors(df: DataFrame, key: str, vec: str, dimensions: int) -> None:
    """ValueError for a wrong size, a value that is not finite, or a repeated id."""
    finite = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = df.agg(F.count_if(F.coalesce((F.size(vec) != dimensions) | ~finite, F.lit(True))).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"{bad} vectors are not {dimensions} finite numbers")
    if not df.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("vector ids repeat")


def knn(queries: DataFrame, base: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "query_vec", key: str = "id", vec: str = "vec", on: list[str] | None = None) -> DataFrame:
    """The k base rows nearest to each query by cosine, ties by id: all columns of base's row, similarity and rank.

    `on` names columns that both sides must share (such as the agent); without it the queries are a stated set that is
    read against all rows in blocks: each base partition meets a counted block of broadcast queries, and only k rows a query and
    partition are shuffled (a limit by group before the exchange).
    """
    if k < 1:
        return base.limit(0).withColumn(query_id, F.lit(None)).withColumn("similarity", F.lit(0.0)).withColumn("rank", F.lit(0))
    q = queries.select(query_id, query_vec, *(on or []), norm(F.col(query_vec)).alias("_qn"))
    base = base.withColumn("_bn", norm(F.col(vec)))
    pairs = base.join(q, on) if on else per_block(q, lambda part: base.join(part, F.lit(True)))
    sim = pairs.withColumn("similarity", cosine(F.col(query_vec), F.col(vec), F.col("_qn"), F.col("_bn"))).drop(query_vec, "_qn", "_bn")
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(key))
    return sim.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Nearest:
    """The k best (similarity to 12 places, id) of each of n queries, ties by id, out of what is added piece by piece."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.q, self.id, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, ok: np.ndarray | None = None) -> None:
        """A matrix of the similarities of queries q (places) and ids; where `ok` is given, only pairs that it marks."""
        if not sim.size:
            return
        if ok is not None:
            sim = np.where(ok, sim, -np.inf)
        at = max(0, sim.shape[1] - self.k)
        least = np.maximum(self.least[q], np.partition(sim, at, axis=1)[:, at] if at else -np.inf)
        r, c = np.nonzero((sim >= least[:, None] - 2e-12) & (sim > -np.inf))
        self.merge(q[r], ids[c], sim[r, c])

    def merge(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Single similarities of queries q (places) and ids; only what is held of these queries is sorted again."""
        if not len(q):
            return
        asked = np.zeros(self.n, bool)
        asked[q] = True
        old = asked[self.q]
        q, ids, sim = np.r_[self.q[old], q], np.r_[self.id[old], ids], np.r_[self.sim[old], sim]
        order = np.lexsort((ids, -np.round(sim, 12), q))
        q, ids, sim = q[order], ids[order], sim[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k
        q, ids, sim = q[keep], ids[keep], sim[keep]
        n = np.bincount(q, minlength=self.n)
        full = np.flatnonzero(n >= self.k)
        self.least[full] = sim[np.cumsum(n)[full] - 1]
        q, ids, sim = np.r_[self.q[~old], q], np.r_[self.id[~old], ids], np.r_[self.sim[~old], sim]
        order = np.argsort(q, kind="stable")
        self.q, self.id, self.sim = q[order], ids[order], sim[order]


def asked_matrix(part: DataFrame, query_id: str, query_vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block of a stated set of queries."""
    t = part.select(F.col(query_id).cast("long").alias("i"), F.transform(query_vec, lambda x: x.cast("double")).alias("v")).toArrow()
    return t["i"].to_numpy(), _matrix(t["v"])


def few_tasks(df: DataFrame) -> DataFrame:
    """`df` in at most three tasks a core, so that what each task leaves (k rows a query) does not grow with the table."""
    return df.coalesce(3 * max(1, df.sparkSession.sparkContext.defaultParallelism))


def knn_matrix(queries: DataFrame, base: DataFrame, k: int, *, query_id: str = "query_id", query_vec: str = "query_vec", key: str = "id", vec: str = "vec", limit: int = BROADCAST_ROWS, code: Codes | None = None) -> DataFrame:
    """As `knn` without groups, but (query_id, id, similarity, rank) only: matrix products over pieces of the base.

    The queries are a stated set; blocks of at most `limit` of them travel with the tasks. A product has at most CELLS
    entries and a task keeps the k best of each query, so memory is that of a block whatever the table's size, and k
    rows a query and task are shuffled. Similarities are rounded to 12 places, so that equal vectors tie whatever piece
    they are in. With `code` (rows, probing -> whole numbers by column) only pairs that share a number in a column count.
    """
    n = max(1, -(-queries.count() // limit))
    out = None
    for i in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(n)) == i)
        if k < 1:
            continue
        ids, q = asked_matrix(part, query_id, query_vec)
        if not len(ids):
            continue

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best, step = Nearest(len(ids), k), max(1, CELLS // len(ids))
            asked, all_ = code(q, True) if code else None, np.arange(len(ids))
            for b in batches:
                own, m = b.column(0).to_numpy(), _matrix(b.column(1))
                width = min(q.shape[1], m.shape[1])
                for at in range(0, len(m), step):
                    piece = m[at : at + step]
                    ok = shared_codes(asked, code(piece, False)) if code else None
                    best.add(all_, own[at : at + step], np.round(q[:, :width] @ piece[:, :width].T, 12), ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.sim)], ["query_id", "id", "similarity"])

        src = base.filter(usable(F.col(vec), 1)).select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
        one = few_tasks(src).mapInArrow(run, "query_id long, id long, similarity double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def shared_codes(asked: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of queries' codes (n, tables, probes) and rows' codes (m, tables): which pairs have one in common."""
    ok = np.zeros((len(asked), len(own)), bool)
    for t in range(own.shape[1]):
        for p in range(asked.shape[2]):
            ok |= asked[:, t, p, None] == own[None, :, t]
    return ok


def knn_blocks(queries: DataFrame, base: DataFrame, k: int | None, *, on: str = "agent", query_id: str = "query_id", query_vec: str = "query_vec", key: str = "id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity) of the base rows of each query's group: the k nearest of every block, ties by id (k None: all).

    A group's rows are dealt into blocks of about `block` by a hash of the id, its queries go to each of them, and a
    block is one matrix product; so a large group is many tasks, and only k rows a query and block leave one.
    Similarities are rounded to 12 places, so that equal vectors tie whatever block they are in.
    """
    rows = base.filter(usable(F.col(vec), 1)).select(F.col(on).cast("string").alias("g"), F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    parts = base.select(F.col(on).cast("string").alias("g")).groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    rows = rows.join(parts, "g").select("g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"), "id", "v")
    asked = queries.select(F.col(on).cast("string").alias("g"), F.col(query_id).cast("long").alias("query_id"), F.transform(query_vec, lambda x: x.cast("double")).alias("v"))
    asked = asked.join(parts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "query_id", "v")

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        q, m, ids = _matrix(asked["v"]), _matrix(rows["v"]), rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        m, ids, width = m[order], ids[order], min(q.shape[1], m.shape[1])
        sim = np.round(q[:, :width] @ m[:, :width].T, 12)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        r = np.repeat(np.arange(len(q)), best.shape[1])
        return pa.table({"query_id": asked["query_id"].to_numpy()[r], "id": ids[best.ravel()], "similarity": sim[r, best.ravel()]})

    return asked.groupBy("g", "p").cogroup(rows.groupBy("g", "p")).applyInArrow(compare, "query_id long, id long, similarity double")


@dataclass(frozen=True)
class Cells:
    """Unit vectors that divide a space: a row belongs to the nearest of the first m of them.

    They are chosen by k-means++ and moved by k-means on a bounded sample; each is as far from those before it as chance
    allows, so that the first few divide a small set as all of them do a large one.

    With `axes` (orthonormal columns) a row is seen as its places along them and the length of what they leave of it.
    Two such views are never farther apart than the rows, so bounds by angles hold, and in few dimensions cells are small.
    """

    centres: np.ndarray
    axes: np.ndarray | None = None

    SAMPLE: ClassVar[int] = 20_000
    MOST: ClassVar[int] = 256
    #: Cells of pairwise comparisons, and how many axes are tried.
    MOST_PAIRED: ClassVar[int] = 512
    AXES: ClassVar[tuple[int, ...]] = (3, 8)

    @classmethod
    def sample(cls, vectors: DataFrame, vec: str = "v", key: str = "k") -> np.ndarray:
        """SAMPLE (key, vec) rows by the hash of their key, as unit vectors; vectors without length do not count."""
        if (share := 1.5 * cls.SAMPLE / max(1, vectors.filter(~is_zero(F.col(vec))).count())) < 1:
            # Of a large table only what may be among the sample is sorted: the same rows by far less than all.
            vectors = vectors.filter(F.xxhash64(key) <= int(-(1 << 63) + share * (1 << 64)))
        got = vectors.filter(~is_zero(F.col(vec))).orderBy(F.xxhash64(key), key).limit(cls.SAMPLE).select(F.transform(vec, lambda x: F.nanvl(x.cast("double"), F.lit(0.0))).alias("v"))
        return _matrix(got.toArrow()["v"])

    @classmethod
    def fit(cls, vectors: DataFrame, n: int, vec: str = "v", key: str = "k", seed: int = 11, rounds: int = 8) -> Cells:
        """At most `n` cells of (key, vec) rows, learnt from a sample of them."""
        return cls.among(cls.sample(vectors, vec, key), n, seed, rounds) if n > 1 else cls(np.zeros((1, 1)))

    @classmethod
    def among(cls, m: np.ndarray, n: int, seed: int = 11, rounds: int = 8) -> Cells:
        """At most `n` cells of unit vectors."""
        if n <= 1 or not len(m):
            return cls(np.zeros((1, 1)))
        r = np.random.default_rng(seed)
        centres, far = [m[0]], 1 - m @ m[0]
        while len(centres) < min(n, len(m)) and far.max() > 1e-9:
            pick = m[r.choice(len(m), p=np.clip(far, 0, None) / np.clip(far, 0, None).sum())]
            centres.append(pick)
            far = np.minimum(far, 1 - m @ pick)
        c = np.array(centres)
        for _ in range(rounds):
            step = max(1, CELLS // len(c))
            own = np.concatenate([np.argmax(m[at : at + step] @ c.T, axis=1) for at in range(0, len(m), step)])
            total = np.zeros_like(c)
            np.add.at(total, own, m)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
        return cls(c)

    @classmethod
    def apart(cls, vectors: DataFrame, n: int, reach: float) -> Cells:
        """The cells, of whole (k, v) rows or of their views along some axes, that let the most pairs at an angle beyond `reach` go."""
        m = cls.sample(vectors) if n > 1 else np.zeros((0, 0))
        best = cls.among(m, n)
        if not len(m):
            return best
        axes = np.linalg.eigh(m.T @ m)[1][:, ::-1]
        tried = [best]
        for p in cls.AXES:
            if p < m.shape[1] - 1:
                view = cls(np.zeros((0, p + 1)), axes[:, :p])
                tried.append(cls(cls.among(view.seen(m), n).centres, view.axes))
        return min(tried, key=lambda c: c.left(m, reach))

    def left(self, unit: np.ndarray, reach: float) -> float:
        """The share of the pairs of rows that lie no farther apart than `reach` allows, by the cells of one of them."""
        own, size, radius = self.own(unit), np.zeros(len(self.centres)), np.zeros(len(self.centres))
        np.add.at(size, own, 1)
        np.maximum.at(radius, own, np.concatenate([far.min(axis=1) for far in self.pieces(unit)]))
        return float(np.mean((self.angles(unit[: CELLS // len(size)]) <= reach + radius) @ size)) / len(unit)

    def seen(self, unit: np.ndarray) -> np.ndarray:
        """Unit rows as the cells see them."""
        if self.axes is None:
            return unit
        width = min(unit.shape[1], len(self.axes))
        along = unit[:, :width] @ self.axes[:width]
        return np.column_stack([along, np.sqrt(np.clip(1 - (along * along).sum(axis=1), 0, None))])

    def in_line(self) -> Cells:
        """The same cells in the order of their place along the direction in which they differ most."""
        middle = self.centres - self.centres.mean(axis=0)
        return Cells(self.centres[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")])

    def angles(self, unit: np.ndarray) -> np.ndarray:
        """The angles of unit rows and all centres; a row without length is at a right angle to all that is seen whole."""
        unit = self.seen(unit)
        width = min(unit.shape[1], self.centres.shape[1])
        return np.arccos(np.clip(unit[:, :width] @ self.centres[:, :width].T, -1, 1))

    def pieces(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """`angles` of some rows after the other, of at most CELLS entries each."""
        step = max(1, CELLS // len(self.centres))
        for at in range(0, len(unit), step):
            yield self.angles(unit[at : at + step])

    def own(self, unit: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        return np.concatenate([np.zeros(0, np.int64), *(far.argmin(axis=1) for far in self.pieces(unit))])


def _matrix(col: pa.Array | pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled up with zeros; as unit vectors unless they have no length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    m = np.zeros((len(sizes), int(sizes.max(initial=0))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = pc.fill_null(col.flatten(), 0.0).to_numpy(zero_copy_only=False)
    return np.divide(m, (length := np.linalg.norm(m, axis=1, keepdims=True)), out=np.zeros_like(m), where=length > 0) if unit else m


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(x) for x in rows), np.int64, len(rows))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), kind))


@dataclass(frozen=True)
class _Side:
    """Rows of one side of a comparison: their unit vectors in doubles and singles, and how many rows each stands for."""

    ids: np.ndarray
    unit: np.ndarray
    single: np.ndarray
    stands: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> _Side:
        unit = _matrix(t["v"])
        return cls(t["k"].to_numpy(), unit, unit.astype(np.float32), t["stands"].to_numpy())

    def take(self, x: np.ndarray) -> _Side:
        return self if len(x) == len(self.ids) else _Side(self.ids[x], self.unit[x], self.single[x], self.stands[x])

    def products(self, other: _Side, same: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, float]]:
        """Products in singles of all rows and some of the other's from a place on, and how far they may be from the exact ones.

        Where the other's places of the rows themselves are given (`same`), such a product counts as less than any.
        """
        step, width = max(1, CELLS // 2 // max(1, len(self.ids))), min(self.unit.shape[1], other.unit.shape[1])
        for at in range(0, len(other.ids), step):
            sim = self.single[:, :width] @ other.single[at : at + step, :width].T
            if same is not None:
                own = np.flatnonzero((same >= at) & (same < at + step))
                sim[own, same[own] - at] = -np.inf
            yield at, sim, (width + 8) * 2.0**-23

    def exact(self, other: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The products in doubles of pairs of places: of all between them if these are not many times as many."""
        width, out = min(self.unit.shape[1], other.unit.shape[1]), np.zeros(len(r))
        if len(r) and 20 * len(r) > len(self.ids) * ((end := c.max() + 1) - (start := c.min())):
            return (self.unit[:, :width] @ other.unit[start:end, :width].T)[r, c - start]
        for at in range(0, len(r), PAIRS):
            part = slice(at, at + PAIRS)
            out[part] = np.einsum("ij,ij->i", self.unit[r[part], :width], other.unit[c[part], :width])
        return out


class _AllPairs:
    """Every pair at the threshold, once."""

    kind, names, twice = "a long, b long, similarity double", ("a", "b", "similarity"), False

    def __init__(self, side: _Side, threshold: float):
        self.side, self.threshold = side, threshold

    def needed(self) -> np.ndarray:
        """The similarity from which on another row matters to each row; infinite if none does any more."""
        return np.full(len(self.side.ids), self.threshold)

    def add(self, x: np.ndarray, other: _Side | None) -> Iterator[tuple[np.ndarray, ...]]:
        """Compares the rows at places x with other rows, or (None) with the side's own; what is found at once."""
        left, right = self.side.take(x), other or self.side
        for at, sim, off in left.products(right, x if other is None else None):
            hot = np.flatnonzero(sim.max(axis=1) >= (least := np.float32(self.threshold - off)))
            r, c = np.nonzero(sim[hot] >= least)
            r = hot[r]
            if other is None:
                once = left.ids[r] < right.ids[at + c]
                r, c = r[once], c[once]
            s = left.exact(right, r, c + at)
            ok = s >= self.threshold - 1e-12
            a, b = left.ids[r[ok]], right.ids[at + c[ok]]
            yield np.minimum(a, b), np.maximum(a, b), s[ok]

    def result(self) -> Iterator[tuple[np.ndarray, ...]]:
        yield from ()


class _BestPairs(_AllPairs):
    """The `keep` best of each row at the threshold, ties by id."""

    twice = True

    def __init__(self, side: _Side, threshold: float, keep: int):
        super().__init__(side, threshold)
        self.best = Nearest(len(side.ids), keep)

    def needed(self) -> np.ndarray:
        return np.maximum(self.threshold, self.best.least - 2e-12)

    def add(self, x: np.ndarray, other: _Side | None) -> Iterator[tuple[np.ndarray, ...]]:
        left, right, k = self.side.take(x), other or self.side, self.best.k
        for at, sim, off in left.products(right, x if other is None else None):
            least = (self.needed()[x] - off).astype(np.float32)
            if not len(hot := np.flatnonzero(sim.max(axis=1) >= least)):
                continue
            sim, least = sim[hot], least[hot]
            ok = sim >= least[:, None]
            # Rows with many candidates first learn what their k best of these come to at least.
            if len(many := np.flatnonzero(np.count_nonzero(ok, axis=1) > 2 * k)):
                part = sim[many]
                kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k]
                ok[many] = part >= np.maximum(least[many], kth - np.float32(2 * off))[:, None]
            r, c = np.nonzero(ok)
            r = hot[r]
            s = left.exact(right, r, c + at)
            good = s >= self.threshold - 1e-12
            self.best.merge(x[r[good]], right.ids[at + c[good]], s[good])
        yield from ()

    def result(self) -> Iterator[tuple[np.ndarray, ...]]:
        yield self.side.ids[self.best.q], self.best.id, self.best.sim


class _Counts(_AllPairs):
    """How many rows there are at the threshold of each row, itself and its copies left out; a row that has `enough` is not compared again."""

    kind, names, twice = "a long, n long", ("a", "n"), True

    def __init__(self, side: _Side, threshold: float, enough: int):
        super().__init__(side, threshold)
        self.n, self.enough = side.stands - 1 if threshold <= 1 else np.zeros(len(side.ids), np.int64), enough

    def needed(self) -> np.ndarray:
        return np.where(self.n < self.enough, self.threshold, np.inf)

    def add(self, x: np.ndarray, other: _Side | None) -> Iterator[tuple[np.ndarray, ...]]:
        left, right = self.side.take(x), other or self.side
        for at, sim, off in left.products(right, x if other is None else None):
            # Rows that got enough of a tile before are left out of the rest.
            hot = np.flatnonzero((sim.max(axis=1) >= np.float32(self.threshold - off)) & (self.n[x] < self.enough))
            sim, stands = sim[hot], right.stands[at : at + sim.shape[1]]
            sure = sim >= np.float32(self.threshold + off)
            self.n[x[hot]] += (sure @ stands.astype(float)).astype(np.int64)
            r, c = np.nonzero((sim >= np.float32(self.threshold - off)) & ~sure)
            good = left.exact(right, hot[r], c + at) >= self.threshold - 1e-12
            np.add.at(self.n, x[hot[r[good]]], stands[c[good]])
        yield from ()

    def result(self) -> Iterator[tuple[np.ndarray, ...]]:
        yield self.side.ids, np.minimum(self.n, self.enough)


def _close_pairs(rows: DataFrame, threshold: float, scratch: Scratch, block: int, find: Callable[[_Side], _AllPairs], what: type[_AllPairs]) -> DataFrame:
    """(g, ...) of what `find` (a `what` for the rows of a side) tells of the different rows (g, k, v, stands) of a group.

    A group of at most one block is one task. A larger one is divided into cells and stored once, a folder for at most
    about a block of a cell; a task holds one block and reads the group's others one after the other, nearest first, so
    the disk in use is that of the rows and memory that of two blocks, however large a group is. A row can only be as
    close as it needs to rows of a cell whose centre is no farther from it than the needed similarity's angle and the
    cell's radius together; a block that no row can match is not read, and only rows that either side may match are
    compared. What a row needs rises with what was found for it. Products are taken in singles, and again in doubles
    where these do not decide.
    """
    kind = f"g {rows.schema['g'].dataType.simpleString()}, {what.kind}"
    sizes = scratch.write(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    few = rows if largest <= block else rows.join(sizes.filter(F.col("n") <= block), "g", "left_semi")

    def whole(t: pa.Table) -> pa.Table:
        f = find(_Side.of(t))
        g = pa.array([t["g"][0].as_py()], t.schema.field("g").type)
        return pa.Table.from_batches([_found_batch(g, what, x) for x in (*f.add(np.arange(len(t)), None), *f.result())])

    out = few.filter(F.col("g").isNotNull()).groupBy("g").applyInArrow(whole, kind)
    if largest <= block:
        return out
    big = sizes.filter(F.col("n") > block).withColumn("gid", F.row_number().over(Window.orderBy("g")))
    big = scratch.write(big, "big")
    rows = rows.join(big, "g")
    cells = Cells.apart(rows, min(Cells.MOST_PAIRED, -(-largest // block)), _angle(threshold))
    used = F.least(F.lit(len(cells.centres)), F.ceil(F.col("n") / block)).cast("int").alias("used")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = cells.angles(_matrix(b.column(2)))
            out = np.arange(far.shape[1]) >= b.column(4).to_numpy()[:, None]
            cell = np.argmin(np.where(out, np.inf, far), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["gid", "k", "v", "stands", "cell", "far"])

    placed = scratch.write(rows.select("gid", "k", "v", "stands", used).mapInArrow(place, "gid int, k long, v array<double>, stands long, cell int, far double"), "placed")
    subs = placed.groupBy("gid", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("subs"))
    dealt = placed.join(subs, ["gid", "cell"]).withColumn("sub", F.pmod(F.xxhash64("k"), F.col("subs")).cast("int"))
    per = scratch.write(dealt.groupBy("gid", "cell", "sub").agg(F.max("far").alias("radius")), "per")
    root = scratch.write_parts(dealt.select("gid", "cell", "sub", "k", "v", "stands"), "blocks", "gid", "cell", "sub")
    scratch.drop("placed")
    items = per.join(per.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("cell", "sub", "radius"))).alias("blocks")), "gid").join(big.select("gid", "g"), "gid")
    items = items.select("g", "gid", "cell", "sub", "radius", "blocks")
    count = per.count()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, item in enumerate(b.to_pylist()):
                gid, cell, sub, radius = (item[c] for c in ("gid", "cell", "sub", "radius"))
                side = _block(root, gid, cell, sub)
                g, f = b.column(0).slice(i, 1), find(side)
                far = np.concatenate([np.zeros((0, len(cells.centres))), *cells.pieces(side.unit)])
                own = Cells(cells.centres[cell : cell + 1], cells.axes)
                # The rows' own block, then the others by how near their cells are to the rows.
                middle = far.mean(axis=0)
                others = sorted((tuple(o.values()) for o in item["blocks"]), key=lambda o: (o[:2] != (cell, sub), o[0] != cell, middle[o[0]], o[1]))
                for c, s, r in others:
                    reach = _angle(f.needed())
                    x = np.flatnonzero(far[:, c] <= reach + r)
                    if not len(x) or not what.twice and (c, s) < (cell, sub):
                        continue
                    other = None
                    if (c, s) != (cell, sub):
                        other = _block(root, gid, c, s)
                        other = other.take(np.flatnonzero(own.angles(other.unit)[:, 0] <= reach[x].max() + radius))
                    for found in f.add(x, other):
                        yield _found_batch(g, what, found)
                for found in f.result():
                    yield _found_batch(g, what, found)

    return out.unionByName(items.repartition(max(1, min(count, 20_000))).mapInArrow(compare, kind))


def _angle(similarity: float | np.ndarray) -> np.ndarray:
    """The angle that rows of at least this similarity lie within, a little more for rounding; less than any for infinity."""
    s = np.asarray(similarity, float)
    return np.where(s < np.inf, np.arccos(np.clip(s, -1, 1)) + 1e-6, -np.inf)


def _found_batch(g: pa.Array, what: type[_AllPairs], found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([g.take(pa.array(np.zeros(len(found[0]), np.int64))), *map(pa.array, found)], ["g", *what.names])


def _block(root: str, gid: int, cell: int, sub: int) -> _Side:
    return _Side.of(read_folder(f"{root}/gid={gid}/cell={cell}/sub={sub}", ["k", "v", "stands"]))


def _classes(df: DataFrame, threshold: float, scratch: Scratch, group: str, key: str, vec: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (g, k, v) of which equal ones count once, by their smallest key; and the members (g, rep, k) of those that do not stand alone."""
    rows = df.filter(usable(F.col(vec))).select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    rows = rows if threshold <= 0 else rows.filter(~is_zero(F.col("v")))
    rows = scratch.write(rows.withColumn("h", F.xxhash64("v")), "rows")
    copies = rows.select("g", "k", "h").join(rows.groupBy("g", "h").count().filter("count > 1").drop("count"), ["g", "h"], "left_semi")
    few = scratch.write(copies, "copies")
    if few.isEmpty():
        return rows.select("g", "k", "v"), None
    same = Window.partitionBy("g", "h", "v")
    alike = rows.join(few.select("g", "k"), ["g", "k"], "left_semi").withColumn("rep", F.min("k").over(same)).select("g", "k", "rep")
    alike = scratch.write(alike, "alike")
    return rows.join(alike.filter("k <> rep"), ["g", "k"], "left_anti").select("g", "k", "v"), alike


def similar_pairs(df: DataFrame, threshold: float, *, group: str = "agent", key: str = "id", vec: str = "vec", ordered: bool = False, block: int = BLOCK) -> DataFrame:
    """(group, a, b, similarity) of the pairs in a group with cosine >= threshold; a < b, or both ways if `ordered`.

    Vectors are read once. Equal ones are compared as one and told apart again at the end.
    """
    scratch = Scratch(df.sparkSession)
    single, members = _classes(df, threshold, scratch, group, key, vec)
    out = _close_pairs(single.withColumn("stands", F.lit(1).cast("long")), threshold, scratch, block, lambda side: _AllPairs(side, threshold), _AllPairs)
    if members is not None:
        pairs = scratch.write(out, "pairs")
        left = members.select("g", F.col("rep").alias("a"), F.col("k").alias("ka"))
        right = members.select("g", F.col("rep").alias("b"), F.col("k").alias("kb"))
        wide = pairs.join(left, ["g", "a"], "left").join(right, ["g", "b"], "left").select("g", F.coalesce("ka", "a").alias("a"), F.coalesce("kb", "b").alias("b"), "similarity")
        own = left.join(right.withColumnRenamed("b", "a"), ["g", "a"]).filter("ka < kb")
        one = own.select("g", F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("similarity")).filter(F.lit(1.0) >= threshold)
        out = wide.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(one)
    if ordered:
        out = out.unionByName(out.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return out.select(F.col("g").alias(group), "a", "b", "similarity")


def neighbours(df: DataFrame, threshold: float, limit: int, *, group: str = "agent", key: str = "id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(group, a, b, similarity, rank): of each row its `limit` most similar others, ties by id.

    Equal rows share one list of the `limit` + 1 nearest, each of which then leaves itself out; so copies cost a list a
    class and `limit` rows each.
    """
    scratch = Scratch(df.sparkSession)
    single, members = _classes(df, threshold, scratch, group, key, vec)
    single = single.withColumn("stands", F.lit(1).cast("long"))
    pairs = scratch.write(_close_pairs(single, threshold, scratch, block, lambda side: _BestPairs(side, threshold, limit + 1), _BestPairs), "pairs")
    w = Window.partitionBy("g", "a").orderBy(F.round("similarity", 12).desc(), "b")
    rank = F.row_number().over(w)
    if members is None:
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit).select(F.col("g").alias(group), "a", "b", "similarity", "rank")
    seen = members.withColumn("_n", F.row_number().over(Window.partitionBy("g", "rep").orderBy("k"))).filter(F.col("_n") <= limit + 1)
    wide = pairs.join(seen.select("g", F.col("rep").alias("b"), F.col("k").alias("kb")), ["g", "b"], "left").select("g", "a", F.coalesce("kb", "b").alias("b"), "similarity")
    own = seen.select("g", F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity")).filter(F.lit(1.0) >= threshold)
    near = wide.unionByName(own).withColumn("rank", rank).filter(F.col("rank") <= limit + 1).groupBy("g", "a").agg(F.sort_array(F.collect_list(F.struct("rank", "b", "similarity"))).alias("near"))
    each = near.join(members.select("g", F.col("rep").alias("a"), F.col("k").alias("ka")), ["g", "a"], "left").withColumn("a", F.coalesce("ka", "a"))
    each = each.select("g", "a", F.posexplode(F.slice(F.filter("near", lambda x: x["b"] != F.col("a")), 1, limit)).alias("pos", "x"))
    return each.select(F.col("g").alias(group), "a", "x.b", "x.similarity", (F.col("pos") + 1).alias("rank"))


def neighbour_counts(df: DataFrame, threshold: float, limit: int, *, group: str = "agent", key: str = "id", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(group, a, n): how many rows `neighbours` has of each row. A row is compared until `limit` are known; copies count as one class."""
    scratch = Scratch(df.sparkSession)
    single, members = _classes(df, threshold, scratch, group, key, vec)
    sizes = single.withColumn("stands", F.lit(1).cast("long"))
    if members is not None:
        many = members.groupBy("g", F.col("rep").alias("k")).agg(F.count(F.lit(1)).alias("_n"))
        sizes = single.join(many, ["g", "k"], "left").select("g", "k", "v", F.coalesce("_n", F.lit(1)).cast("long").alias("stands"))
    out = _close_pairs(sizes, threshold, scratch, block, lambda side: _Counts(side, threshold, limit), _Counts)
    if members is not None:
        out = out.join(members.select("g", F.col("rep").alias("a"), F.col("k").alias("ka")), ["g", "a"], "left").withColumn("a", F.coalesce("ka", "a"))
    return out.select(F.col("g").alias(group), "a", "n")


@dataclass(frozen=True)
class LshIndex:
    """Random hyperplanes: a vector's bucket in a table is the signs of its products with the table's planes.

    The number of planes grows with the logarithm of the rows, so buckets hold about `ROWS_A_BUCKET` of them however
    many there are; a query also reads the buckets one flip of its least certain signs away (`probes` of them a table).
    """

    dimensions: int
    tables: int = 24
    bits: int = 4
    seed: int = 100
    probes: int = 0

    ROWS_A_BUCKET: ClassVar[int] = 64

    @classmethod
    def for_rows(cls, dimensions: int, rows: int, **options: int) -> LshIndex:
        """An index for so many rows."""
        bits = max(4, math.ceil(math.log2(max(1, rows) / cls.ROWS_A_BUCKET)))
        return cls(dimensions, **({"bits": min(bits, 30), "probes": 2, "tables": 12} | options))

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dimensions))

    def codes(self, m: np.ndarray, probing: bool = False) -> np.ndarray:
        """The bucket of each row (rows, tables); of rows that ask also those of their least certain signs flipped (rows, tables, 1 + probes)."""
        side = (m @ self.planes().reshape(-1, self.dimensions).T[: m.shape[1]]).reshape(len(m), self.tables, self.bits)
        power = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        own = (side > 0) @ power
        if not probing:
            return own
        near = np.argsort(np.abs(side), axis=2)[:, :, : self.probes]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ power[near]], axis=2)

    def buckets(self, vec: Column, probing: bool = False) -> Column:
        """(table, bucket) of a vector, where bucket holds the table in its upper bits: a row a table and probed bucket."""
        tables = self.tables

        @F.arrow_udf("array<long>")
        def signs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                codes = self.codes(_matrix(b, unit=False), probing).reshape(len(b), tables, -1)
                yield _lists(list((codes | (np.arange(tables, dtype=np.int64) << 32)[:, None]).reshape(len(b), -1)), pa.int64())

        return F.posexplode(signs(vec)).alias("table", "bucket")

    def manifest(self, digest: str, rows: int) -> str:
        return json.dumps({"engine": "lsh", "version": 1, "rows": rows, "source": digest} | asdict(self), sort_keys=True)

    def candidates(self, queries: DataFrame, base: DataFrame) -> DataFrame:
        """(query_id, id): the rows that share a bucket with a query."""
        b = base.select("id", self.buckets(F.col("vec")))
        q = queries.select("query_id", self.buckets(F.col("query_vec"), True))
        return q.select("query_id", "bucket").join(b.select("id", "bucket"), "bucket").select("query_id", "id").distinct()

    def search(self, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
        """Approximate knn: rows that share a bucket with the query in some table, ranked exactly.

        Candidates are found and ranked where the rows are, so no pair of a query and a row that shares a bucket is written.
        """
        return knn_matrix(queries, base, k, code=self.codes)


@dataclass(frozen=True)
class ExactIndex:
    """Every row is compared; the measure of all other indexes."""

    dimensions: int

    def manifest(self, digest: str, rows: int) -> str:
        return json.dumps({"engine": "exact", "version": 1, "rows": rows, "source": digest} | asdict(self), sort_keys=True)

    def search(self, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
        return knn_matrix(queries, base, k)


class StaleIndexError(RuntimeError):
    """A saved index does not belong to the rows it is to serve."""


def create_index(engine: str, dimensions: int, rows: int | None = None, **options: int) -> LshIndex | ExactIndex:
    """`auto` and `lsh` are approximate (made for `rows` rows, if that is known), `exact` is not; other names are ValueErrors."""
    if engine in ("auto", "lsh"):
        return LshIndex(dimensions, **options) if rows is None else LshIndex.for_rows(dimensions, rows, **options)
    if engine == "exact":
        return ExactIndex(dimensions)
    raise ValueError(f"unknown index engine {engine!r}")


def load_index(manifest: str, digest: str, rows: int) -> LshIndex | ExactIndex:
    """The index that a manifest describes, or StaleIndexError if version, source or row count are not those at hand."""
    try:
        m = json.loads(manifest)
        engine, version = m.pop("engine"), m.pop("version")
        if version != 1 or m.pop("source") != digest or m.pop("rows") != rows:
            raise StaleIndexError("the index was built from other rows")
        return create_index(engine, m.pop("dimensions"), **m)
    except (ValueError, KeyError, TypeError) as e:
        raise StaleIndexError(f"unreadable manifest: {e}") from e


def recall(spark: SparkSession, found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query_id, id) pairs that `found` has."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count()
    return hit / max(1, exact.count())
