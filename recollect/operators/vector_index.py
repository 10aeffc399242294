"""A stored inverted-file index: posting lists by cell, written once, with changes as further lists and tombstones."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import create_once, names, read_text, remove
from .blocks import BROADCAST_ROWS
from .vectors import CELLS, Cells, Nearest, StaleIndexError, _lists, _matrix, asked_matrix, check_vectors, few_tasks


def _probes(cells: Cells, unit: np.ndarray, probes: int) -> list[np.ndarray]:
    """The cells nearest to each row; all of them if it is as far from each."""
    out = []
    for far in cells.pieces(unit):
        best = np.argsort(far, axis=1, kind="stable")
        same = far.max(axis=1) - far.min(axis=1) < 1e-12
        out += [b.copy() if s else b[:probes].copy() for b, s in zip(best, same, strict=True)]
    return out


class StoredIndex:
    """Rows (id, vec) in posting lists by the nearest of some cells; a search reads the lists of the cells near a query alone.

    Under `root`, `state/<version>.json` names the files of a version: `cells/<id>` (the centres), `lists/<id>` (postings
    in the order of their cells, a folder for as many cells as hold about FOLDER_ROWS rows) and `gone/<id>` (ids whose older postings no longer hold). Files are never changed and a version
    is written by one of several writers at once, so readers see one version whole. `source` says what the index was
    made from; a reader that expects another is refused. After MERGE_AT changes the lists are written anew.
    """

    MERGE_AT, KEEP, MOST_CELLS, FOLDER_ROWS = 16, 5, 4096, 100_000

    def __init__(self, spark: SparkSession, root: str, version: int, state: dict):
        self.spark, self.root, self.version, self.state = spark, root, version, state
        self._cells: Cells | None = None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, StoredIndex) and (self.root, self.version, self.state) == (other.root, other.version, other.state)

    __hash__ = None

    @staticmethod
    def cells_for(rows: int) -> int:
        """Four times the square root, so that lists and centres grow alike."""
        return max(1, min(StoredIndex.MOST_CELLS, 4 * math.isqrt(max(0, rows))))

    @classmethod
    def load(cls, spark: SparkSession, root: str, source: object = None) -> StoredIndex:
        """The last version; StaleIndexError if there is none, its files are damaged or it was made from another source."""
        root = root.rstrip("/")
        last = [n for n in names(spark, f"{root}/state") if n.endswith(".json")]
        try:
            state = json.loads(read_text(spark, f"{root}/state/{last[-1]}"))
            if state["format"] != 1 or not all(isinstance(state[k], t) for k, t in (("dimensions", int), ("rows", int), ("lists", list), ("cells", str))):
                raise StaleIndexError("the index has another format")
            if any(not names(spark, f"{root}/lists/{x}") for x in state["lists"]) or not names(spark, f"{root}/cells/{state['cells']}"):
                raise StaleIndexError("files of the index are missing")
        except (ValueError, KeyError, TypeError, IndexError) as e:
            raise StaleIndexError(f"no readable index: {e}") from e
        if source is not None and state["source"] != source:
            raise StaleIndexError("the index was made from other rows")
        return cls(spark, root, int(last[-1][:-5]), state)

    @classmethod
    def build(cls, rows: DataFrame, root: str, dimensions: int, *, source: object = None, cells: int | None = None, probes: int | None = None) -> StoredIndex:
        """Divides (id, vec) rows, checked for size, finite values and unique ids, into `cells` learnt from a bounded sample."""
        spark, root = rows.sparkSession, root.rstrip("/")
        check_vectors(rows, "id", "vec", dimensions)
        n = rows.count()
        cells = cells or cls.cells_for(n)
        model = Cells.fit(rows, cells, "vec", "id").in_line()
        name = uuid.uuid4().hex
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.centres)], "cell int, centre array<double>").write.parquet(f"{root}/cells/{name}")
        state = {"format": 1, "dimensions": dimensions, "rows": n, "lists": [], "gone": [], "cells": name, "probes": probes or max(4, len(model.centres) // 24), "folders": max(1, min(len(model.centres), n // cls.FOLDER_ROWS)), "source": source}
        old = [x for x in names(spark, f"{root}/state") if x.endswith(".json")]
        index = cls(spark, root, int(old[-1][:-5]) if old else 0, state)
        index._cells = model
        return index._commit(state | {"lists": [index._write(rows)]})

    def _commit(self, state: dict) -> StoredIndex:
        if not create_once(self.spark, f"{self.root}/state/{self.version + 1:020d}.json", json.dumps(state)):
            raise StaleIndexError("another writer has changed the index")
        if self.version >= self.KEEP:
            remove(self.spark, f"{self.root}/state/{self.version + 1 - self.KEEP:020d}.json")
        return StoredIndex(self.spark, self.root, self.version + 1, state)

    @property
    def cells(self) -> Cells:
        if self._cells is None:
            rows = sorted(self.spark.read.parquet(f"{self.root}/cells/{self.state['cells']}").collect())
            self._cells = Cells(np.array([r["centre"] for r in rows]))
        return self._cells

    def _placed(self, rows: DataFrame) -> DataFrame:
        cells = self.cells

        @F.arrow_udf("int")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for v in batches:
                yield pa.array(cells.own(_matrix(v)).astype(np.int32))

        return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).withColumn("cell", nearest("vec"))

    def _folder(self, cell: int | Column) -> int | Column:
        at = cell * self.state["folders"] / len(self.cells.centres)
        return at.cast("int") if isinstance(at, Column) else int(at)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        placed = self._placed(rows)
        # By cell and id, so that a cell of very many rows is several tasks and files.
        placed = placed.withColumn("folder", self._folder(F.col("cell"))).repartitionByRange("cell", "id").sortWithinPartitions("cell")
        placed.write.partitionBy("folder").option("maxRecordsPerFile", 1_000_000).parquet(f"{self.root}/lists/{name}")
        return name

    def add(self, rows: DataFrame, source: object = None) -> StoredIndex:
        """The next version, with new vectors of these (id, vec) rows in place of what their ids had."""
        check_vectors(rows, "id", "vec", self.state["dimensions"])
        return self.change(rows, rows.select("id"), source)

    def remove(self, ids: DataFrame, source: object = None) -> StoredIndex:
        """The next version without these ids."""
        return self.change(None, ids.select("id"), source)

    def change(self, rows: DataFrame | None, gone: DataFrame, source: object = None) -> StoredIndex:
        name = uuid.uuid4().hex
        gone.select(F.col("id").cast("long")).distinct().write.parquet(f"{self.root}/gone/{name}")
        lists = list(self.state["lists"])
        state = self.state | {"gone": [*self.state["gone"], [len(lists), name]], "source": source}
        if rows is not None and not rows.isEmpty():
            state["lists"] = [*lists, self._write(rows)]
        out = self._commit(state)
        return out.merged() if len(state["gone"]) >= self.MERGE_AT else out

    def merged(self) -> StoredIndex:
        """The next version, with all that holds in one set of lists."""
        rows = self.rows()
        return self._commit(self.state | {"lists": [self._write(rows)], "gone": [], "rows": rows.count()})

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(id, vec, cell) of what the index holds, of the given cells alone."""
        parts = []
        for i, name in enumerate(self.state["lists"]):
            p = self.spark.read.schema("id long, vec array<double>, cell int, folder int").parquet(f"{self.root}/lists/{name}")
            if cells is not None:
                p = p.filter(F.col("folder").isin(sorted({self._folder(c) for c in cells})) & F.col("cell").isin(cells))
            parts.append(p.drop("folder").withColumn("_list", F.lit(i)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if self.state["gone"]:
            gone = None
            for before, name in self.state["gone"]:
                g = self.spark.read.schema("id long").parquet(f"{self.root}/gone/{name}").withColumn("_before", F.lit(before))
                gone = g if gone is None else gone.unionByName(g)
            gone = gone.groupBy(F.col("id").alias("_gone")).agg(F.max("_before").alias("_before"))
            out = out.join(gone, (F.col("id") == F.col("_gone")) & (F.col("_list") < F.col("_before")), "left_anti")
        return out.drop("_list")

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, query_vec, cell): the cells nearest to each query; a zero vector is at the same distance from all, so it gets all."""
        cells = self.cells
        p = min(probes or self.state["probes"], len(cells.centres))

        @F.arrow_udf("array<int>")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for v in batches:
                yield _lists(_probes(cells, _matrix(v), p), pa.int32())

        return queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).withColumn("cell", F.explode(nearest("query_vec")))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest of the rows in the probed cells, ties by id; all cells make it exact."""
        if k < 1:
            return self.spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
        out, n, limit = None, queries.count(), BROADCAST_ROWS
        for i in range(parts := -(-n // limit)):
            part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            one = self._search(part, k, min(probes or self.state["probes"], len(self.cells.centres)))
            out = one if out is None or one is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
        return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def _search(self, queries: DataFrame, k: int, probes: int) -> DataFrame | None:
        """(query_id, id, similarity) of a block of queries, which travels with the tasks that read the lists: k rows a query leave a task.

        A list is compared with the queries that probe its cell where it is read, so no query is sent once a cell.
        """
        ids, q = asked_matrix(queries, "query_id", "query_vec")
        if not len(ids):
            return None
        cells, all_ = self.cells, probes >= len(self.cells.centres)
        near = None if all_ else _probes(cells, q, probes)
        asked = [] if all_ else np.split(np.repeat(np.arange(len(ids)), [len(x) for x in near])[order := np.argsort(np.concatenate(near), kind="stable")], np.searchsorted(np.concatenate(near)[order], np.arange(1, len(cells.centres))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(len(ids), k)
            for b in batches:
                own, m, cell = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
                for c in [0] if all_ else np.unique(cell):
                    rows, at = (np.arange(len(m)), np.arange(len(ids))) if all_ else (np.flatnonzero(cell == c), asked[c])
                    step = max(1, CELLS // max(1, len(at)))
                    for i in range(0, len(rows) if len(at) else 0, step):
                        piece = rows[i : i + step]
                        width = min(q.shape[1], m.shape[1])
                        best.add(at, own[piece], np.round(q[at, :width] @ m[piece, :width].T, 12))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.id), pa.array(best.sim)], ["query_id", "id", "similarity"])

        rows = self.rows(None if all_ else [c for c, at in enumerate(asked) if len(at)])
        return few_tasks(rows.select("id", "vec", "cell")).mapInArrow(run, "query_id long, id long, similarity double")

    def reads(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, share): how much of all rows a query's cells hold."""
        sizes = self.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        total = max(1, self.rows().count())
        per = self.probed(queries, probes).join(sizes, "cell", "left").groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        return per.select("query_id", (F.col("n") / total).alias("share"))
