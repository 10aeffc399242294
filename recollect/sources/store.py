"""The table store: an append-only change log per table, snapshots, and one state of all tables that writers replace one at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEYS, TABLES, check_contract, schema_digest, with_defaults
from .files import create_once, names, read_text, remove, write_atomic


class Conflict(RuntimeError):
    """Another writer changed the table first."""


T = TypeVar("T")


class Transaction:
    """Reads of one version of the store, and changes of several tables that are committed together or not at all."""

    def __init__(self, store: Store):
        self.store, self.tables = store, store.state()[1]
        self.read: dict[str, int] = {}
        self.written: dict[str, list[str]] = {}
        self.ids: dict[str, int] = {}

    def current(self, table: str) -> DataFrame:
        """The table's rows as this transaction sees them: those of its version and its own changes."""
        state = self.store.of(self.tables, table)
        self.read[table] = state["version"]
        return self.store._read(table, state | {"batches": [*state["batches"], *self.written.get(table, [])]})

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.written.setdefault(table, []).append(self.store._batch(table, rows, "upsert"))

    def delete(self, table: str, keys: DataFrame) -> None:
        self.written.setdefault(table, []).append(self.store._batch(table, keys, "delete"))

    def take_ids(self, table: str, n: int = 1) -> int:
        """The first of n ids that no row of the table ever had."""
        state = self.store.of(self.tables, table)
        self.read[table] = state["version"]
        first = self.ids.get(table, state["next_id"])
        self.ids[table] = first + n
        return first

    def commit(self, before: Callable[[dict, dict], None] | None = None) -> None:
        def change(table: str) -> Callable[[dict], dict]:
            return lambda s: s | {"batches": [*s["batches"], *self.written.get(table, [])], "next_id": max(s["next_id"], self.ids.get(table, 0))}

        if not self.written:
            return
        new = self.store.commit({t: change(t) for t in {*self.written, *self.ids}}, self.read, before)
        for table in self.written:
            if len(self.store.of(new, table)["batches"]) >= self.store.compact_at:
                self.store.compact(table)


class Store:
    """Tables under `root`: `<table>/log/<batch>` holds changes (business columns and op), `<table>/snapshot/<id>` compacted rows.

    `state/<version>` names, for every table, its snapshot and the batches that came after it, in order. A commit writes
    the next version, for one table or several at once, which only one of several writers can do; the others read the
    new state and try again, so no batch and no id is lost or given twice. Files are never changed. Readers see one
    version whole. A commit may name what it has read, and is refused if that has changed. After `compact_at` batches a
    table is compacted, so what a reader merges is bounded. `dimensions` fixes vector sizes.
    """

    #: Older states that are kept, and attempts of a commit.
    KEEP, ATTEMPTS = 20, 50

    def __init__(self, spark: SparkSession, root: str, dimensions: int = 128, compact_at: int = 32):
        if not 1 <= dimensions <= 2000:
            raise ValueError("dimensions must be from 1 to 2000")
        self.spark, self.root, self.dimensions, self.compact_at, self.open = spark, root.rstrip("/"), dimensions, compact_at, False

    def close(self) -> None:
        """Refuses further use; repeating it changes nothing."""
        self.open = False

    def initialize(self) -> Store:
        """Writes the schema receipt, or refuses a root that has another."""
        want = {"dimensions": self.dimensions, "tables": {t: schema_digest(s) for t, s in TABLES.items()}}
        have = read_text(self.spark, f"{self.root}/_schema.json")
        if have is None:
            write_atomic(self.spark, f"{self.root}/_schema.json", json.dumps(want, sort_keys=True))
        elif json.loads(have) != want:
            raise RuntimeError("the store has another schema or other dimensions")
        self.open = True
        return self

    def state(self) -> tuple[int, dict[str, dict]]:
        """(version, state by table) of the whole store; a table's state counts its own changes as `version`."""
        if not self.open:
            raise RuntimeError("the store is not initialised, or closed")
        last = [n for n in names(self.spark, f"{self.root}/state") if n.endswith(".json")]
        return (int(last[-1][:-5]), json.loads(read_text(self.spark, f"{self.root}/state/{last[-1]}"))) if last else (0, {})

    @staticmethod
    def of(tables: dict[str, dict], table: str) -> dict:
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}")
        return tables.get(table) or {"version": 0, "snapshot": None, "batches": [], "next_id": 1, "done": {}}

    def _state(self, table: str) -> tuple[int, dict]:
        """(version, state) of a table."""
        state = self.of(self.state()[1], table)
        return state["version"], state

    def commit(self, changes: dict[str, Callable[[dict], dict]], base: dict[str, int] | None = None, before: Callable[[dict, dict], None] | None = None) -> dict[str, dict]:
        """Makes each table's change(state) its next state, all at once; returns the states of all tables.

        With `base` (versions by table) only if these are still the versions of its tables, else Conflict. `before` gets
        the old and the new states and runs ahead of the attempt; what it raises ends it.
        """
        for _ in range(self.ATTEMPTS):
            version, old = self.state()
            for table, seen in (base or {}).items():
                if self.of(old, table)["version"] != seen:
                    raise Conflict(f"{table} has changed since it was read")
            new = dict(old)
            for table, change in changes.items():
                was = self.of(old, table)
                now = change(json.loads(json.dumps(was)))
                new[table] = now if now == was else now | {"version": was["version"] + 1}
            if new == old:
                return old
            if before is not None:
                before(old, new)
            if create_once(self.spark, f"{self.root}/state/{version + 1:020d}.json", json.dumps(new)):
                if version > self.KEEP:
                    remove(self.spark, f"{self.root}/state/{version - self.KEEP:020d}.json")
                return new
        raise Conflict(f"{self.ATTEMPTS} attempts to commit failed")

    def _commit(self, table: str, change: Callable[[dict], dict], base: int | None = None, before: Callable[[dict, dict], None] | None = None) -> dict:
        return self.of(self.commit({table: change}, None if base is None else {table: base}, before), table)

    def transact(self, work: Callable[[Transaction], T], before: Callable[[dict, dict], None] | None = None) -> T:
        """Runs work(transaction) and commits what it wrote at once; if another writer changed what it read, it runs again."""
        for _ in range(self.ATTEMPTS):
            t = Transaction(self)
            out = work(t)
            try:
                t.commit(before)
                return out
            except Conflict:
                continue
        raise Conflict(f"{self.ATTEMPTS} attempts of a transaction failed")

    def _batch(self, table: str, changes: DataFrame, op: str) -> str:
        if op not in ("upsert", "delete"):
            raise ValueError(f"unknown op {op!r}")
        batch = uuid.uuid4().hex
        rows = with_defaults(changes, table) if op == "upsert" else changes.select(*KEYS[table], *[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table].fields if f.name not in KEYS[table]]).select(*TABLES[table].names)
        rows.withColumn("op", F.lit(op)).write.parquet(f"{self.root}/{table}/log/{batch}")
        return batch

    def append(self, table: str, changes: DataFrame, op: str = "upsert", *, base: int | None = None, before: Callable[[dict, dict], None] | None = None, done: tuple[str, int] | None = None) -> None:
        """Adds whole row images (op upsert) or keys (op delete); batches committed later win.

        `done` is the name of a stream and the number of its micro-batch: one that the table has taken already, or an
        older one, changes nothing.
        """
        if done and self._state(table)[1]["done"].get(done[0], -1) >= done[1]:
            return
        batch = self._batch(table, changes, op)

        def change(s: dict) -> dict:
            if done is None:
                return s | {"batches": [*s["batches"], batch]}
            return s if s["done"].get(done[0], -1) >= done[1] else s | {"batches": [*s["batches"], batch], "done": s["done"] | {done[0]: done[1]}}

        if len(self._commit(table, change, base, before)["batches"]) >= self.compact_at:
            self.compact(table)

    def insert(self, table: str, rows: DataFrame, before: Callable[[dict, dict], None] | None = None, order: str | None = None) -> DataFrame:
        """Rows without id get ids above all that ever were, in the order of the rows; returns what was stored.

        `order` names a column of monotonically_increasing_id, made before the rows were dealt anew, that keeps their order.
        """
        # Rows are staged with ids that grow by partition; offsets of the partitions then close the gaps, so that no
        # task numbers all rows and a repeated task gives the same ids.
        stage = f"{self.root}/{table}/staging/{uuid.uuid4().hex}"
        rows = rows.withColumnRenamed(order, "_m") if order else rows.withColumn("_m", F.monotonically_increasing_id())
        rows.write.parquet(stage)
        part = self.spark.read.parquet(stage).withColumn("_p", F.shiftright("_m", 33))
        counts = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        n = part.count()
        start = self._commit(table, lambda s: s | {"next_id": s["next_id"] + n})["next_id"] - n
        out = part.join(F.broadcast(offsets), "_p").withColumn("id", F.col("_m") - F.col("_first") + F.col("_before") + start).drop("_p", "_m", "_n", "_first", "_before")
        try:
            self.append(table, out, before=before)
        finally:
            remove(self.spark, stage)
        return self.current(table).filter((F.col("id") >= start) & (F.col("id") < start + n))

    def _log(self, table: str, batches: list[str], snapshot: str | None = None) -> DataFrame:
        """The last image of each key, with the op that made it, of some batches in their order and a snapshot before them."""
        parts = [self.spark.read.parquet(f"{self.root}/{table}/log/{b}").withColumn("seq", F.lit(i + 1)) for i, b in enumerate(batches)]
        if snapshot:
            parts.append(self.spark.read.parquet(f"{self.root}/{table}/snapshot/{snapshot}").withColumn("op", F.lit("upsert")).withColumn("seq", F.lit(0)))
        if not parts:
            return self.spark.createDataFrame([], TABLES[table]).withColumn("op", F.lit("upsert"))
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p)
        if batches:
            w = Window.partitionBy(*KEYS[table]).orderBy(F.col("seq").desc())
            log = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        return log.select(*TABLES[table].names, "op")

    def _read(self, table: str, state: dict) -> DataFrame:
        return self._log(table, state["batches"], state["snapshot"]).filter("op = 'upsert'").drop("op")

    def current(self, table: str) -> DataFrame:
        """The last image of each key that was not deleted."""
        return self._read(table, self._state(table)[1])

    def mark(self, table: str) -> dict:
        """What names the table's present state: its snapshot and the batches after it."""
        return {k: self._state(table)[1][k] for k in ("snapshot", "batches")}

    def since(self, table: str, mark: dict | None) -> DataFrame | None:
        """The last change of each key (columns and op) that came after `mark`; None if the table was compacted since."""
        state = self._state(table)[1]
        if not mark or state["snapshot"] != mark["snapshot"] or state["batches"][: len(mark["batches"])] != mark["batches"]:
            return None
        return self._log(table, state["batches"][len(mark["batches"]) :])

    def update(self, table: str, condition: Column, changes: dict[str, Column], before: Callable[[dict, dict], None] | None = None) -> int:
        """New images of the rows that meet `condition`; returns how many there were. Rows that another writer changes
        meanwhile are read again."""
        for _ in range(self.ATTEMPTS):
            version, state = self._state(table)
            hit = self._read(table, state).filter(condition)
            n = hit.count()
            if not n or not changes:
                return n
            try:
                self.append(table, hit.withColumns(changes), base=version, before=before)
                return n
            except Conflict:
                continue
        raise Conflict(f"{table}: {self.ATTEMPTS} attempts to update failed")

    def update_from(self, table: str, changes: DataFrame) -> int:
        """Many keyed updates at once: `changes` has the table's key and new values of some columns; returns how many rows they met."""
        keys = KEYS[table]
        new = [c for c in changes.columns if c not in keys]
        for _ in range(self.ATTEMPTS):
            version, state = self._state(table)
            hit = self._read(table, state).drop(*new).join(changes, keys)
            n = hit.count()
            if not n:
                return 0
            try:
                self.append(table, hit, base=version)
                return n
            except Conflict:
                continue
        raise Conflict(f"{table}: {self.ATTEMPTS} attempts to update failed")

    def set_vector(self, table: str, row_id: int, agent: str, vector: list[float]) -> None:
        """Replaces one row's vector; it must have the store's dimensions and meet exactly one row."""
        if len(vector) != self.dimensions or not all(abs(x) < float("inf") for x in vector):
            raise ValueError(f"a vector needs {self.dimensions} finite numbers")
        n = self.update(table, (F.col("id") == row_id) & (F.col("agent") == agent), {"embedding": F.lit([float(x) for x in vector]).cast("array<float>")})
        if n != 1:
            raise RuntimeError(f"{n} rows have this id and agent, not one")

    def invalidate(self, ids: list[int], at: Column, agent: str, before: Callable[[dict, dict], None] | None = None) -> int:
        """Marks an agent's live memories as no longer valid; those of other agents are left alone."""
        return self.update("memories", F.col("id").isin(ids) & (F.col("agent") == agent) & F.col("invalid_at").isNull(), {"invalid_at": at}, before)

    def delete(self, table: str, keys: DataFrame) -> None:
        self.append(table, keys, "delete")

    def compact(self, table: str) -> None:
        """Writes the current rows as a snapshot sorted by agent, and points to it; batches that come meanwhile stay."""
        state, name = self._state(table)[1], uuid.uuid4().hex
        cur = self._read(table, state)
        order = [c for c in KEYS[table] if c != "agent"]
        cur.repartitionByRange("agent").sortWithinPartitions("agent", *order).write.parquet(f"{self.root}/{table}/snapshot/{name}")
        taken = state["batches"]

        def point(s: dict) -> dict:
            if s["snapshot"] != state["snapshot"] or s["batches"][: len(taken)] != taken:
                return s  # another writer has compacted it; this snapshot stays unused
            return s | {"snapshot": name, "batches": s["batches"][len(taken) :]}

        self._commit(table, point)

    def vacuum(self) -> int:
        """Removes batches, snapshots and staged rows that no kept state names; returns how many. For times without writers,
        whose files are not named yet."""
        kept = [json.loads(read_text(self.spark, f"{self.root}/state/{n}")) for n in names(self.spark, f"{self.root}/state") if n.endswith(".json")]
        n = 0
        for table in TABLES:
            used = {x for state in kept for x in (*self.of(state, table)["batches"], self.of(state, table)["snapshot"])}
            for folder in ("log", "snapshot", "staging"):
                for name in names(self.spark, f"{self.root}/{table}/{folder}"):
                    if name not in used:
                        remove(self.spark, f"{self.root}/{table}/{folder}/{name}")
                        n += 1
        return n

    def fetch_value(self, df: DataFrame):
        """The first column of the first row, None without rows."""
        row = df.first()
        return row[0] if row else None

    def check(self, table: str) -> None:
        check_contract(self.current(table), table, self.dimensions)
