import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.agent import Agent
from recollect.operators import integrity as I
from recollect.operators import vectors as V
from recollect.sources.files import create_once, file_digest, is_digest
from recollect.sources.store import Conflict, Store


def test_agents_leave_each_other_alone(spark, tmp_path):
    a, b = Agent(spark, "Ada", f"file://{tmp_path}/s"), Agent(spark, "Bob", f"file://{tmp_path}/s")
    own, other = a.remember(["mine"]), b.remember(["yours"])
    assert not a.forget(other[0]) and not a.update(other[0], importance=1) and a.get(other[0]).count() == 0
    assert b.count() == 1 and b.list().first()["importance"] == 5
    i = b.instincts.create("x", "y")
    assert not a.instincts.activate(i) and not a.instincts.delete(i) and a.instincts.get(i) is None and b.instincts.get(i) is not None
    assert a.forget(own[0]) and a.count() == 0 and b.count() == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    stores = [Store(spark, root, compact_at=5).initialize(), Store(spark, root, compact_at=5).initialize()]
    ids, errors = [], []

    def write(s):
        try:
            for _ in range(4):
                ids.extend(r["id"] for r in s.insert("instincts", spark.createDataFrame([("A", "p", "x")] * 3, "agent string, trigger_pattern string, action string")).select("id").collect())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(ids) == list(range(1, 25))
    assert sorted(r["id"] for r in stores[0].current("instincts").collect()) == list(range(1, 25))
    assert len(stores[0]._state("instincts")[1]["batches"]) < 5  # compacted on the way
    seen = stores[0]._state("instincts")[0]
    stores[1].update("instincts", F.col("id") == 1, {"action": F.lit("z")})
    with pytest.raises(Conflict):
        stores[0].append("instincts", stores[0].current("instincts"), base=seen)
    assert stores[0].update("instincts", F.col("id") <= 2, {"confidence": F.lit(0.9)}) == 2
    assert stores[0].current("instincts").filter("id = 1").first()["action"] == "z"
    assert create_once(spark, f"{root}/x", "a") and not create_once(spark, f"{root}/x", "b") and is_digest(file_digest(spark, f"{root}/x")) and not is_digest("x")


def test_closed_store_and_bad_input(spark, tmp_path):
    with Agent(spark, "Ada", f"file://{tmp_path}/c") as a:
        i = a.remember(["text"])[0]
        a.store.set_vector("memories", i, "Ada", [0.5] * 128)
        assert a.get(i).first()["embedding"][0] == 0.5
        with pytest.raises(RuntimeError):
            a.store.set_vector("memories", i, "Bob", [0.5] * 128)
        with pytest.raises(ValueError):
            a.store.set_vector("memories", i, "Ada", [float("nan")] * 128)
        with pytest.raises(ValueError):
            a.store.current("no such table")
    with pytest.raises(RuntimeError):
        a.count()


def test_protected_memories_are_served_only_as_sealed(spark, tmp_path):
    a = Agent(spark, "Ada", f"file://{tmp_path}/g")
    a.remember(["one"])
    signer = I.TrustStore({"k": I.HmacSigner(b"key")}, "k")
    guard = a.protect(signer)
    i = a.remember(["two"])[0]
    assert a.count() == 2 and guard.checkpoint.sequence == 2
    a.verify_integrity()
    again = Agent(spark, "Ada", f"file://{tmp_path}/g")
    again.protect(signer)  # the witness is in the store, so another driver goes on with it
    assert again.count() == 2
    a.store.update("memories", F.col("id") == i, {"importance": F.lit(10)})  # past the facade
    for x in (a, again):
        with pytest.raises(I.IntegrityError):
            x.list().count()
    with pytest.raises(I.IntegrityError):
        Agent(spark, "Bob", f"file://{tmp_path}/g").verify_integrity()


def test_index_of_an_agent_is_bound_to_its_memories(spark, tmp_path):
    a = Agent(spark, "Ada", f"file://{tmp_path}/i")
    with pytest.raises(V.StaleIndexError):
        a.load_index()
    a.remember(["one", "two", "three"])
    assert a.build_index() == a.load_index() and a.build_index("exact") == a.load_index()
    a.remember(["four"])
    with pytest.raises(V.StaleIndexError):
        a.load_index()


def test_graph_is_replaced(spark, tmp_path):
    a = Agent(spark, "Ada", f"file://{tmp_path}/n")
    ids = a.remember(["the deploy of the server failed with an error in NASA", "the deploy of the server failed with an error in ESA", "tea"])
    assert a.graph.build() == "Connectome [DRY-RUN] — Ada: 3 nodes, 2 edges, 2 entities"
    assert a.graph.build(dry_run=False) == "Connectome [LIVE] — Ada: 3 nodes, 2 edges, 2 entities"
    a.forget(ids[1])
    assert a.graph.build(dry_run=False) == "Connectome [LIVE] — Ada: 2 nodes, 0 edges, 1 entities"
    assert a.graph.conflicts().count() == 0
    assert a.route(["tea"], 0.1).first()["route"] == "fast_path"


def test_lsh_grows_with_the_rows(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((300, 32))
    m = (centres[rng.integers(0, 300, 12_000)] + 0.35 * rng.standard_normal((12_000, 32))).astype(float)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").repartition(4).cache()
    q = base.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    index = V.create_index("lsh", 32, 12_000)
    assert index.bits > V.create_index("lsh", 32, 1000).bits and V.LshIndex.for_rows(32, 10**9).bits > 20
    exact = V.create_index("exact", 32).search(q, base, 10)
    share = index.candidates(q, base).count() / (q.count() * 12_000)
    recall = V.recall(spark, index.search(q, base, 10), exact)
    print("recall", recall, "share of rows read", share)
    assert recall >= 0.9 and share < 0.3


def test_blocks_of_a_group_give_its_nearest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"g{i % 3}", rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(300)]
    base = spark.createDataFrame(rows, "id long, agent string, vec array<double>")
    q = base.filter("id < 6").select(F.col("id").alias("query_id"), "agent", F.col("vec").alias("query_vec"))
    got = {}
    for r in V.knn_blocks(q, base, 5, block=20).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-300)
    for i in range(6):
        want = sorted((-round(float(unit(rows[i][2]) @ unit(v)), 12), j) for j, g, v in rows if g == rows[i][1])[:5]
        assert [j for _, j in sorted(got[i])[:5]] == [j for _, j in want]
    assert V.knn_blocks(q, base, None).count() == 600
    near = V.neighbours(base, 0.2, 3, block=25).collect()
    assert max(r["rank"] for r in near) <= 3
    whole = V.neighbours(base, 0.2, 3).collect()
    assert {(r["a"], r["b"]) for r in near} == {(r["a"], r["b"]) for r in whole}
