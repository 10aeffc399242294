import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollect import cli
from recollect.agent import Agent
from recollect.operators import migration as Q
from recollect.sources import providers as P
from recollect.sources.store import Store
from recollect.streaming import activity


def test_agent_life(spark, tmp_path):
    a = Agent(spark, "Ada", f"file://{tmp_path}/s")
    ids = a.remember(["I love Python programming", "The weather is sunny today", "Python is great for AI"], importance=7)
    assert len(set(ids)) == 3
    assert any("Python" in r.content for r in a.recall("Python", limit=2).collect())
    assert a.count() == 3 and a.update(ids[0], content="I love tea", importance=9) and not a.update(10**9, importance=1)
    assert a.get(ids[0]).first()["content"] == "I love tea"
    assert a.forget(ids[1]) and not a.forget(ids[1]) and a.count() == 2 and a.list(include_invalid=True).count() == 3
    more = a.remember(["next"])
    assert more[0] > max(ids)
    b = Agent(spark, "Bob", f"file://{tmp_path}/s")
    assert b.count() == 0
    a.set_identity("Curious", {"O": 0.8, "C": 0.9, "E": 0.6, "A": 0.7, "N": 0.2})
    a.set_identity(personality="Calm")
    with pytest.raises(ValueError):
        a.set_identity(ocean={"O": 2.0})
    a.set_rule("r1", "never lie", "critical")
    a.reflect("a thought", "calm")
    boot = a.boot()
    assert "Calm" in boot and "O=0.800" in boot and "- r1: never lie" in boot and "a thought" in boot
    assert a.snapshot()["n_rules"] == 1
    assert {r.phase for r in a.sleep().collect()} == {"replay", "forget", "prune", "consolidate"}
    a.sleep(dry_run=False)
    assert a.count() == 3
    a.store.compact("memories")
    assert a.count() == 3
    a.store.check("memories")
    with pytest.raises(RuntimeError):
        Store(spark, f"file://{tmp_path}/s", 64).initialize()


def test_store_deletes_and_restores(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t").initialize()
    rows = spark.createDataFrame([("A", "p", "x")], "agent string, trigger_pattern string, action string")
    i = s.insert("instincts", rows).first()["id"]
    s.delete("instincts", spark.createDataFrame([(i,)], "id long"))
    assert s.current("instincts").count() == 0
    assert s.insert("instincts", rows).first()["id"] > i


def test_migration_resumes(spark, tmp_path):
    src, cand, mark = (f"file://{tmp_path}/{x}" for x in ("src", "cand", "mark.json"))
    spark.range(1, 6).select("id", F.concat(F.lit("text "), F.col("id")).alias("content"), F.array_repeat(F.lit(0.25).cast("float"), 128).alias("embedding")).write.parquet(src)
    embed = lambda df: P.HashEmbedder(1024).embed(df, "id", "_text").select("id", "embedding")
    assert Q.migrate(spark, src, cand, mark, embed, dry_run=True)["status"] == "planned"
    assert Q.migrate(spark, src, cand, mark, embed, ranges=2, max_ranges=1)["status"] == "running"
    with pytest.raises(ValueError):
        Q.migrate(spark, src, cand, mark, embed, ranges=3, resume=True)
    assert Q.migrate(spark, src, cand, mark, embed, ranges=2, resume=True)["status"] == "complete"
    assert spark.read.parquet(f"{cand}/range=0", f"{cand}/range=1").filter("size(embedding) = 1024").count() == 5
    assert spark.read.parquet(src).filter("size(embedding) = 128").count() == 5
    assert Q.rollback(spark, mark) == Q.rollback(spark, mark)
    state = f"file://{tmp_path}/cli.json"
    assert cli.main(["migrate", "run", state, "--source", src, "--candidate", f"{cand}1", "--dimensions", "64", "--ranges", "2"]) == 0
    assert cli.main(["migrate", "rollback", state]) == 0 and cli.main(["migrate", "run", state]) == 2
    bad = lambda df: df.select("id", F.array(F.lit(float("nan")).cast("float")).alias("embedding"))
    with pytest.raises(RuntimeError):
        Q.migrate(spark, src, f"{cand}2", f"{mark}2", bad, ranges=1)


def test_providers(spark, tmp_path):
    with pytest.raises(ValueError):
        P.loopback("http://example.com")
    assert P.loopback("http://127.0.0.1:1/") == "http://127.0.0.1:1"
    import numpy as np

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    m = P.ModelEmbedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    assert [r.v for r in m.embed(df, "id", "t", "v").orderBy("id").collect()] == [[2.0, 1.0], [0.0, 1.0]]
    assert df.select(P.unpack_vectors(P.pack_vectors(F.array(F.lit(0.5), F.lit(2.0)))).alias("v")).first()["v"] == [0.5, 2.0]
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table t (id integer primary key, name text)")
        c.executemany("insert into t(name) values (?)", [(f"n{i}",) for i in range(25)])
    assert P.read_sqlite(spark, str(db), "t", "id long, name string", ranges=4).count() == 25


def test_streams(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"file://{tmp_path}/ev"
    ev.repartition(3).write.parquet(src)
    stream = activity.read_events(spark, src, ev.schema)
    q = activity.windowed(stream, late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, activity.windowed(ev).collect()))
    assert activity.sessions(ev).agg(F.sum("n")).first()[0] == ev.count()
    got = {}
    act = stream.filter("event_id % 5 = 0").select(F.col("user_id").alias("id"), F.lit(0.5).alias("confidence"))
    def keep(b, _):
        got.update({r.id: (r.confidence, r.activations) for r in b.collect()})
    w = activity.instinct_state(act).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    w.awaitTermination(120)
    counts = {r.user_id: r["count"] for r in ev.filter("event_id % 5 = 0").groupBy("user_id").count().collect()}
    for i, n in counts.items():
        c = 0.5
        for _ in range(n):
            c = round(min(1.0, c + 0.1 * (1 - c)), 4)
        assert got[i] == (pytest.approx(c, abs=2e-4), n)


def test_cli(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/cli"
    assert cli.main(["--root", root, "create", "Eve", "--ocean", "0.8,0.9,0.6,0.7,0.2"]) == 0
    assert cli.main(["--root", root, "remember", "Eve", "tea is hot", "--importance", "8"]) == 0
    capsys.readouterr()
    assert cli.main(["--root", root, "recall", "Eve", "tea"]) == 0 and "tea is hot" in capsys.readouterr().out
    assert cli.main(["--root", root, "reflect", "Eve", "hm"]) == 0 and cli.main(["--root", root, "boot", "Eve"]) == 0
    assert "Soy" in capsys.readouterr().out
    assert cli.main(["--root", root, "snapshot", "Eve"]) == 0 and json.loads(capsys.readouterr().out)["last_thought"] == "hm"
    assert cli.main(["--root", root, "remember", "Eve", "x", "--importance", "11"]) == 2 and cli.main(["nope"]) == 2
