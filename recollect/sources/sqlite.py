"""SQLite tables as a Spark data source: ranges of rows as partitions, filters that the database applies itself."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Rows that are fetched, and passed on, at once.
FETCH = 10_000
_KINDS = ((("INT",), LongType()), (("CHAR", "CLOB", "TEXT"), StringType()), (("REAL", "FLOA", "DOUB"), DoubleType()), (("BOOL",), BooleanType()))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Rows(InputPartition):
    """Rows whose rowid is from `low` up to, without, `high`."""

    low: int
    high: int


class SqliteSource(DataSource):
    """`spark.read.format("sqlite_table")` with options path, table, ranges (16) and pushdown (false).

    The path must be one that all executors share. Types follow the declared ones (integers, text, reals, booleans, else
    bytes) unless a schema is given.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with closing(_open(self.options["path"])) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"there is no table {self.options['table']!r}")
        kind = lambda declared: next((t for words, t in _KINDS if any(w in declared.upper() for w in words)), BinaryType())
        return StructType([StructField(c[1], kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else SqliteReader
        return kind(self.options["path"], self.options["table"], int(self.options.get("ranges", 16)), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, ranges: int, schema: StructType):
        self.path, self.table, self.ranges, self.columns = path, table, max(1, ranges), schema
        self.terms: list[str] = []
        self.values: list[Any] = []

    def partitions(self) -> list[Rows]:
        with closing(_open(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [Rows(i, min(i + step, high + 1)) for i in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.columns)
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.terms])
        with closing(_open(self.path)) as db:
            found = db.execute(f"SELECT {','.join(map(_quoted, self.columns.names))} FROM {_quoted(self.table)} WHERE {where}", [partition.low, partition.high, *self.values])
            while rows := found.fetchmany(FETCH):
                values = [[None if v is None else bool(v) for v in c] if pa.types.is_boolean(f.type) else list(c) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, schema, strict=True)], schema=schema)


class PushingReader(SqliteReader):
    """The same with conditions that the file applies; it must not be used for two queries."""

    #: Comparisons whose meaning is the same in both.
    SIGNS = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def _term(self, f: Filter) -> tuple[str, list] | None:
        """A filter as a condition with parameters, or None if the database would not mean the same."""
        if isinstance(f, Not):
            inner = self._term(f.child) if not isinstance(f.child, EqualNullSafe) else None
            return inner and (f"NOT ({inner[0]})", inner[1])
        path = getattr(f, "attribute", ())
        if len(path) != 1 or path[0] not in self.columns.names:
            return None
        name, kind = _quoted(path[0]), self.columns[path[0]].dataType
        if isinstance(f, IsNull | IsNotNull):
            return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
        if not isinstance(kind, LongType | StringType | DoubleType):
            return None
        if isinstance(f, In):
            values = list(f.value)
            return (f"{name} IN ({','.join('?' * len(values))})", values) if 0 < len(values) <= 500 and None not in values else None
        sign = self.SIGNS.get(type(f))
        return (f"{name} {sign} ?", [f.value]) if sign else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.terms, self.values = [], []
        for f in filters:
            term = self._term(f)
            if term is None:
                yield f  # Spark applies it
            else:
                self.terms.append(term[0])
                self.values.extend(term[1])


def read_table(spark: SparkSession, path: str, table: str, schema: str | None = None, *, ranges: int = 16, pushdown: bool = False) -> DataFrame:
    """A SQLite table. With `pushdown` the file itself applies conditions on its columns.

    Spark keeps the conditions of the first query with what was read, so then read the table anew for each query; this is
    why it is off unless asked for.
    """
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    r = spark.read.format("sqlite_table").options(path=path, table=table, ranges=str(ranges), pushdown=str(pushdown).lower())
    return (r.schema(schema) if schema else r).load()
