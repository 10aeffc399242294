"""SQLite tables as a data source: partitions, types, nulls and pushed conditions."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from recollect.sources.sqlite import SqliteReader, read_table


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "x y.db")
    with sqlite3.connect(path) as c:
        c.execute('create table "odd ""name" (id integer primary key, name text, score real, raw blob, "a b" bigint)')
        c.executemany('insert into "odd ""name" values (?, ?, ?, ?, ?)', [(i * 7, None if i % 5 == 0 else f"n{i}", i / 4 if i % 3 else None, bytes([i % 256]), i) for i in range(1, 101)])
        c.execute("create table empty (id integer primary key, name text)")
    return path


def test_a_table_is_read_whole_in_partitions(spark, db):
    df = read_table(spark, db, 'odd "name', ranges=6)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double"), ("raw", "binary"), ("a b", "bigint")]
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 6 and sorted(r.id for r in rows) == [i * 7 for i in range(1, 101)]
    assert sum(r.name is None for r in rows) == 20 and sum(r.score is None for r in rows) == 33
    assert read_table(spark, db, "empty").collect() == []
    assert read_table(spark, db, 'odd "name', "name string, id long").filter("id = 7").collect() == [("n1", 7)]
    with pytest.raises(Exception, match="no table"):
        read_table(spark, db, "none")


def test_conditions_reach_the_file(spark, db, monkeypatch):
    df = read_table(spark, db, 'odd "name', ranges=3)
    assert df.filter("id = 7").count() == df.filter("id = 14").count() == 1  # nothing of one query is kept for the next
    all_ = {r.id: r for r in df.collect()}
    cases = [
        (F.col("id") >= 350, lambda r: r.id >= 350),
        ((F.col("name") == "n7") | (F.col("name") == "n8"), lambda r: r.name in ("n7", "n8")),
        (F.col("name").isin("n1", "n2", "zz") & (F.col("score") < 0.3), lambda r: r.name in ("n1", "n2") and r.score is not None and r.score < 0.3),
        (F.col("name").isNull(), lambda r: r.name is None),
        (~(F.col("a b") <= 90) & F.col("score").isNotNull(), lambda r: r["a b"] > 90 and r.score is not None),
        (F.col("name").eqNullSafe(F.lit(None)), lambda r: r.name is None),
        (F.upper("name") == "N9", lambda r: r.name == "n9"),
    ]
    for condition, plain in cases:
        assert {r.id for r in read_table(spark, db, 'odd "name', ranges=3, pushdown=True).filter(condition).collect()} == {i for i, r in all_.items() if plain(r)}
    plan = read_table(spark, db, 'odd "name', pushdown=True).filter(F.col("id") == 14)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left for Spark to filter
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = SqliteReader(db, 'odd "name', 2, df.schema)
    reader.terms, reader.values = ['"id" = ?'], [14]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
