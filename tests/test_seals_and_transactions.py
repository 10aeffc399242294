"""Seals that no changed cell passes, hash trees that only re-read what changed, and commits of several writers at once."""

import multiprocessing as mp

import pytest
from pyspark.sql import functions as F
from recollect.agent import Agent
from recollect.operators import integrity as I
from recollect.sources.store import Conflict, Store


def _hashes(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(I.row_hash(df, df.columns)).collect()]


def test_rows_that_differ_have_different_hashes(spark):
    rows = [("x\x1fy", "z"), ("x", "y\x1fz"), (None, "z"), ("\x00", "z"), ("", "z"), ("-", "z"), ("1:x", "z"), ("x", "1:z"), ("z", None), ("x1:", "z")]
    assert len(set(_hashes(spark, rows, "a string, b string"))) == len(rows)
    lists = [(["a", "b"],), (["a, b"],), (["a"],), ([None],), ([],), (None,)]
    assert len(set(_hashes(spark, lists, "a array<string>"))) == len(lists)
    maps = [({"a": 1.0, "b": 2.0},), ({"b": 2.0, "a": 1.0},), ({"a": 1.0},), ({"a": None},)]
    h = _hashes(spark, maps, "a map<string,double>")
    assert h[0] == h[1] and len(set(h)) == 3
    assert len(set(_hashes(spark, [([1.0, 2.0],), ([1.0, 2.0000002],), ([1.0],)], "v array<float>"))) == 3


ROWS = [(i, "A" if i % 2 else "B", f"text {i}", [float(i), 1.0]) for i in range(60)]
SCHEMA = "id long, agent string, content string, embedding array<float>"


def test_any_changed_cell_is_refused(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    g = I.Guard("s", "A", I.HmacSigner(b"k"), I.StoredWitness(spark, f"file://{tmp_path}/w"), block=10)
    g.seal(df)
    assert g.verified(df).count() == 30
    at = F.col("id") == 31
    for c, v in (("content", F.lit("x\x1fy")), ("content", F.lit(None).cast("string")), ("content", F.lit("\x00")), ("embedding", F.array(F.lit(31.0), F.lit(1.0001)).cast("array<float>")), ("id", F.lit(1031).cast("long"))):
        bad = df.withColumn(c, F.when(at, v).otherwise(F.col(c)))
        with pytest.raises(I.IntegrityError):
            g.verified(bad)
        with pytest.raises(I.IntegrityError):
            g.verified_keys(bad, [33])
        if c != "id":
            assert g.verified_keys(bad, [3]).count() == 1  # in another block
    with pytest.raises(I.IntegrityError):
        g.verified(df.filter("id <> 31"))
    with pytest.raises(I.IntegrityError):
        g.verified(df.withColumn("more", F.lit(1)))


def test_a_change_costs_its_blocks_and_launders_nothing(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    g = I.Guard("s", "A", I.HmacSigner(b"k"), I.StoredWitness(spark, f"file://{tmp_path}/w"), block=10)
    g.seal(df)
    new = df.withColumn("content", F.when(F.col("id") == 25, "new").otherwise(F.col("content")))
    seen = []
    hashes = g._hashes
    g._hashes = lambda d: seen.append(d.count()) or hashes(d)
    c = g.reseal(df, new, [2])
    assert seen == [5, 5] and c.sequence == 2 and g.verified(new).count() == 30  # five rows of the agent in the block, twice
    del g._hashes
    elsewhere = new.withColumn("content", F.when(F.col("id") == 41, "forged").otherwise(F.col("content")))
    g.reseal(elsewhere, elsewhere.withColumn("content", F.when(F.col("id") == 27, "third").otherwise(F.col("content"))), [2])
    with pytest.raises(I.IntegrityError):  # the forged row kept its old hash
        g.verified(elsewhere.withColumn("content", F.when(F.col("id") == 27, "third").otherwise(F.col("content"))))
    with pytest.raises(I.IntegrityError):  # nor can a forged row be changed and sealed
        g.reseal(elsewhere, elsewhere, [4])


def test_a_change_and_its_seal_are_one_step(spark, tmp_path):
    a = Agent(spark, "Ada", f"file://{tmp_path}/p")
    i, j = a.remember(["one", "two"])
    guard = a.protect(I.HmacSigner(b"k"))
    a.update(i, importance=9)
    assert guard.checkpoint.sequence == 2 and a.get(i).first()["importance"] == 9 and a.count() == 2
    fail = lambda old, new: (a._seal(old, new), (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # sealed, but never committed: nothing is served
        a.store.update("memories", F.col("id") == j, {"importance": F.lit(1)}, fail)
    with pytest.raises(I.IntegrityError):
        a.list().count()
    b = Agent(spark, "Eve", f"file://{tmp_path}/p2")
    k = b.remember(["x"])[0]
    b.protect(I.HmacSigner(b"k"))
    b.store.update("memories", F.col("id") == k, {"embedding": F.array_repeat(F.lit(0.5), 128).cast("array<float>")})  # past the seal
    for read in (lambda: b.get(k).count(), lambda: b.list().count(), lambda: b.recall("x").count()):
        with pytest.raises(I.IntegrityError):
            read()


def test_transactions_are_whole_and_refuse_what_changed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t").initialize()
    rule = lambda k, v: spark.createDataFrame([(1, "A", k, v)], "id long, agent string, rule_key string, content string")

    def half(t):
        t.upsert("rules", rule("r", "x"))
        t.upsert("instincts", spark.createDataFrame([(7, "A", "p", "a")], "id long, agent string, trigger_pattern string, action string"))
        raise KeyError

    with pytest.raises(KeyError):
        s.transact(half)
    assert s.current("rules").count() == s.current("instincts").count() == 0
    tries = []

    def count(t):
        n = t.current("rules").count()
        if not tries:
            s.append("rules", rule("other", "y"))  # another writer comes in between
        tries.append(n)
        t.upsert("rules", rule("seen", str(n)))
        t.upsert("working_state", spark.createDataFrame([("A", "{}", n)], "agent string, state string, turn_count int"))
        return t.current("rules").count()

    assert s.transact(count) == 2 and tries == [0, 1]
    assert s.current("working_state").first()["turn_count"] == 1
    with pytest.raises(Conflict):
        s.commit({"rules": lambda x: x | {"batches": []}}, {"rules": 0})
    before = s.current("rules").count()
    s.append("rules", rule("stream", "1"), done=("q", 4))
    s.append("rules", rule("stream", "2"), done=("q", 4))  # a batch that is repeated
    s.append("rules", rule("stream", "3"), done=("q", 3))
    assert s.current("rules").count() == before + 1 and s.current("rules").filter("rule_key = 'stream'").first()["content"] == "1"
    files = lambda: sum(1 for x in tmp_path.rglob("part-*.parquet"))
    old = files()
    assert s.vacuum() == 4 and files() < old and s.current("rules").count() == before + 1


def _drift(root: str, n: int) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a = Agent(spark, "Ada", root)
    for _ in range(n):
        a.identity.drift({"O": 0.01})
        a.remember(["a memory"])


def test_two_processes_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    a = Agent(spark, "Ada", root)
    a.set_identity(ocean={"O": 0.5})
    other = mp.get_context("spawn").Process(target=_drift, args=(root, 4))
    other.start()
    for _ in range(4):
        a.identity.drift({"O": 0.01})
        a.remember(["another memory"])
    a.sleep(dry_run=False)
    other.join(240)
    assert other.exitcode == 0
    assert a.identity.ocean()["O"] == pytest.approx(0.58)
    ids = [r.id for r in a.store.current("memories").collect()]
    assert len(ids) == len(set(ids)) == 8
