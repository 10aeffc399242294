import datetime as dt
import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import schema
from recollect.operators import agents as A
from recollect.operators import consolidation as C
from recollect.operators import graph as G
from recollect.operators import integrity as I
from recollect.operators import memory as M
from recollect.operators import structures as S
from recollect.operators import vectors as V

def now():
    return F.timestamp_seconds(F.lit(1_782_864_000))


def mem(spark, rows):
    """rows: (id, agent, content, vec) and a dict of other fields."""
    out = []
    for i, agent, content, vec, kw in rows:
        d = {"category": "fact", "importance": 5, "valence": 0.0, "arousal": 0.0, "utility_score": 0.5, "confidence_score": 1.0, "relevance_score": 1.0, "last_activation": None, "identity_defining": False, "invalid_at": None, "created_at": dt.datetime(2026, 6, 30), "scope": "private"} | kw
        out.append((i, agent, content, vec, *d.values()))
    s = "id long, agent string, content string, vec array<double>, category string, importance int, valence double, arousal double, utility_score double, confidence_score double, relevance_score double, last_activation timestamp, identity_defining boolean, invalid_at timestamp, created_at timestamp, scope string"
    return spark.createDataFrame(out, s)


def test_knn_and_bad_vectors(spark):
    base = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.9, 0.1, 0.0]), (30, [0.0, 1.0, 0.0]), (40, [0.0, 0.0, 1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, query_vec array<double>")
    assert [r.id for r in V.knn(q, base, 2).orderBy("rank").collect()] == [10, 20]
    assert [(r.id, r.rank) for r in V.knn_matrix(q, base, 2).orderBy("rank").collect()] == [(10, 1), (20, 2)]
    assert V.knn_matrix(q, base, 9).count() == 4 and V.knn_matrix(q.limit(0), base, 2).count() == V.knn_matrix(q, base.limit(0), 2).count() == 0
    V.check_vectors(base, "id", "vec", 3)
    for bad in ([(1, [1.0])], [(1, [1.0, 2.0, float("nan")])], [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0])]):
        with pytest.raises(ValueError):
            V.check_vectors(spark.createDataFrame(bad, "id long, vec array<double>"), "id", "vec", 3)
    with pytest.raises(ValueError):
        V.create_index("other", 3)
    m = V.create_index("lsh", 3).manifest("d", 4)
    assert V.load_index(m, "d", 4) == V.LshIndex(3)
    for bad in (("e", 4), ("d", 5)):
        with pytest.raises(V.StaleIndexError):
            V.load_index(m, *bad)
    with pytest.raises(V.StaleIndexError):
        V.load_index("{", "d", 4)


def test_similar_pairs_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    rows = [(i, f"a{i % 2}", [float(x) for x in v[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, agent string, vec array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.6}
    assert {(r.a, r.b) for r in V.similar_pairs(df, 0.6, block=7).collect()} == want
    both = V.similar_pairs(df, 0.6, block=7, ordered=True).collect()
    assert len(both) == 2 * len(want)


def search(spark, rows, query, vec, **kw):
    q = spark.createDataFrame([(0, "A", query, vec)], "query_id long, agent string, query string, query_vec array<double>")
    return [(r.id, round(r.similarity, 3)) for r in M.search(mem(spark, rows), q, now(), **kw).orderBy("rank").collect()]


def test_search(spark):
    rows = [(1, "A", "coffee", [1.0, 0.0], {}), (2, "A", "tea", [0.0, 1.0], {"importance": 9}), (3, "A", "coffee again", [1.0, 0.0], {"importance": 9}), (4, "B", "coffee", [1.0, 0.0], {}), (5, "A", "gone", [1.0, 0.0], {"invalid_at": dt.datetime(2026, 1, 1)}), (6, "A", "Literal needle", None, {})]
    assert [i for i, _ in search(spark, rows, "x", [1.0, 0.0], limit=2)] == [3.0, 1.0]
    assert 6 in [i for i, _ in search(spark, rows, "NEEDLE", [0.0, 0.0], candidates=1)]
    assert 6 not in [i for i, _ in search(spark, rows, "NEEDLE", [0.0, 0.0], candidates=1, literal=False)]
    assert {i for i, _ in search(spark, rows, "x", [1.0, 0.0], min_importance=9)} == {2, 3}
    assert {i for i, _ in search(spark, rows, "", [1.0, 0.0])} == {1, 2, 3}


def test_phases(spark):
    today = dt.datetime(2026, 7, 1)
    rows = [
        (1, "A", "x", [1.0, 0.0], {"relevance_score": 0.5, "last_activation": today}), (2, "A", "x", [0.0, 1.0], {"relevance_score": 0.95, "last_activation": today}), (3, "A", "x", [1.0, 1.0], {"relevance_score": 0.8}),
        (4, "A", "x", [1.0, -1.0], {"relevance_score": 0.8, "importance": 9}), (5, "A", "x", [2.0, 1.0], {"relevance_score": 0.8, "valence": 0.9, "arousal": 0.9}), (6, "A", "x", [1.0, 5.0], {"relevance_score": 0.01, "importance": 3}), (7, "A", "x", [5.0, 1.0], {"relevance_score": 0.01, "importance": 3, "identity_defining": True}),
    ]
    m = mem(spark, rows)
    rep = {r.id: r.relevance_score for r in C.replay(m, now()).collect()}
    assert round(rep[1], 6) == 0.6 and rep[2] == 1.0 and rep[3] == 0.8
    fade = {r.id: r.relevance_score for r in C.forget(m, now()).collect()}
    assert fade[3] < 0.8 and fade[4] == 0.8 and fade[3] < fade[5] < 0.8
    gone = {r.id for r in C.prune(m, now()).filter("invalid_at is not null").collect()}
    assert gone == {6}
    assert C.prune(m, now(), below=2.0, most=2).filter("affected").count() == 2
    live, report = C.run_phases(m, now(), dry_run=False)
    assert {r.phase for r in report.collect()} == {"replay", "forget", "prune", "consolidate"} and live.count() == 7
    text = C.report_summary(report, dry_run=False).first()["summary"].split("\n")
    assert text[0] == "Sleep Gate [LIVE] — A" and text[1] == "  REPLAY: 2 affected" and text[-1].startswith("  Total: ")


def sequential(items, sims, t, compat):
    lost, merges, rel = set(), 0, {}
    for i in range(len(items)):
        if i in lost:
            continue
        for j in range(i + 1, len(items)):
            if j in lost or sims.get((i, j), 0) < t:
                continue
            win, lose = (j, i) if items[j] > items[i] else (i, j)
            rel[win] = min(1.0, items[win][1] + 0.05)
            lost.add(lose)
            merges += 1
            if lose == i and not compat:
                break
    return lost, merges, rel


@pytest.mark.parametrize("compat", [True, False])
def test_merge_matches_a_sequential_model(spark, compat):
    rnd = random.Random(5)
    for case in range(3):
        n = 12
        items = [(rnd.randrange(1, 5), rnd.choice([0.2, 0.5, 0.9])) for _ in range(n)]
        sims = {(i, j): 0.95 for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.3}
        m = mem(spark, [(i, "A", "x", [1.0, 0.0], {"importance": a, "relevance_score": r}) for i, (a, r) in enumerate(items)])
        pairs = spark.createDataFrame([("A", i, j, s) for (i, j), s in sims.items()], "agent string, a long, b long, similarity double")
        got = C.merge_decisions(m, pairs, compat=compat).collect()
        lost, merges, rel = sequential(items, sims, 0.92, compat)
        assert {r.id for r in got if r.invalidated} == lost and sum(r.merges for r in got) == merges
        assert {r.id: round(r.relevance_score, 6) for r in got if r.merges} == {k: round(v, 6) for k, v in rel.items()}


def test_route(spark):
    h = mem(spark, [(1, "A", "x", [1.0, 0.0], {})])
    c = spark.createDataFrame([("A", 1, [1.0, 0.0], 0.3), ("A", 2, [1.0, 0.0], 0.8), ("A", 3, [0.0, 1.0], 0.3), ("B", 4, [1.0, 0.0], 0.3)], "agent string, cand_id long, vec array<double>, utility double")
    got = {r.cand_id: r for r in C.route(c, h).collect()}
    assert [got[i].route for i in (1, 2, 3, 4)] == ["fast_path", "full_processing", "full_processing", "full_processing"]
    assert got[4].surprise == 1.0 and got[3].reason == "high surprise (1.000>=0.3)" and got[2].rpe == 0.0


def test_graph(spark):
    m = mem(spark, [(1, "A", "it is right", [1.0, 0.1], {}), (2, "A", "it is wrong", [1.0, 0.0], {}), (3, "A", "it is", [1.0, 0.05], {"category": "correction"}), (4, "B", "it is wrong", [1.0, 0.0], {})])
    e = {(r.src, r.dst): r.type for r in G.similarity_edges(m).collect()}
    assert e == {(1, 2): "EXCITES", (2, 1): "EXCITES", (1, 3): "INHIBITS", (3, 1): "INHIBITS", (2, 3): "INHIBITS", (3, 2): "INHIBITS"}
    assert {(r.memory_id_a, r.memory_id_b): r.signal for r in G.semantic_conflicts(m).collect()} == {(1, 2): "wrong", (1, 3): "correction_category", (2, 3): "wrong"}
    edges = spark.createDataFrame([("A", 1, 2, "EXCITES", 0.7), ("A", 1, 2, "INHIBITS", 0.9), ("A", 2, 1, "EXCITES", 0.5)], "agent string, src long, dst long, type string, weight double")
    assert [(r.memory_id_a, r.memory_id_b, r.similarity) for r in G.edge_contradictions(edges).collect()] == [(1, 2, 0.9)]
    assert "0 conflicts (" in G.conflict_summary("A", 0, 1, 2) and "3 conflicts found" in G.conflict_summary("A", 3, 1, 2)


def test_trees(spark):
    pts = spark.createDataFrame([(2, 4), (5, 6), (8, 2)], "idx long, value long")
    r = spark.createDataFrame([(2, 5), (5, 8), (1, 10), (9, 2)], "lo long, hi long")
    assert {(x.lo, x.hi): x.total for x in S.range_sums(pts, r).collect()} == {(2, 5): 10, (5, 8): 8, (1, 10): 12, (9, 2): 0}
    k = spark.createDataFrame([(3,), (4,), (9,), (11,), (99,)], "k long")
    assert {x.k: x.idx for x in S.find_kth(spark.createDataFrame([(1, 3), (3, 5), (7, 2)], "idx long, value long"), k, 10).collect()} == {3: 1, 4: 3, 9: 7, 11: 10, 99: 10}
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 15.0, 15.0), (3, 50.0, 50.0, 60.0, 60.0)], "id long, min_x double, min_y double, max_x double, max_y double")
    q = spark.createDataFrame([(1, 3.0, 3.0, 7.0, 7.0), (2, 15.0, 15.0, 50.0, 50.0)], "query_id long, min_x double, min_y double, max_x double, max_y double")
    assert {(x.query_id, x.id) for x in S.box_join(b, q, 4.0).collect()} == {(1, 1), (1, 2), (2, 2), (2, 3)}
    keys = spark.createDataFrame([("deploy to staging",), ("deploy to production",), ("debug memory leak",), ("deploy to staging",)], "key string")
    assert [x.key for x in S.autocomplete(keys, "deploy").collect()] == ["deploy to production", "deploy to staging"]
    p = spark.createDataFrame([("de",), ("deploy",), ("x",)], "prefix string")
    assert {x.prefix: x.n for x in S.prefix_counts(keys, p).collect()} == {"de": 3, "deploy": 2, "x": 0}
    log = spark.createDataFrame([("c", i, k) for i, k in enumerate("abcabd")], "cache string, seq int, key string")
    assert tuple(S.lru_simulation(log, 2).first())[:4] == ("c", 0, 6, 4)


def test_merkle_of_any_size(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows, want = [], {}
    for n in range(1, 9):
        level = [sha(f"{n}/{i}") for i in range(n)]
        rows += [(n, i, h) for i, h in enumerate(level)]
        while len(level) > 1:
            level = [sha(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        want[n] = level[0]
    df = spark.createDataFrame(rows, "t int, idx long, hash string")
    assert {r.t: r.root for r in S.merkle_root(df, "t").collect()} == want
    path = {}
    for r in S.merkle_proof(df, "t").collect():
        path.setdefault((r.t, r.leaf), []).append((r.level, r.sibling, r.side))
    for n, i, h in rows:
        for _, s, side in sorted(path.get((n, i), [])):
            h = sha(h + s) if side == "right" else sha(s + h)
        assert h == want[n]


def test_integrity(spark):
    df = spark.createDataFrame([(1, "A", 5), (2, "A", 6), (3, "B", 7)], "id long, agent string, importance int")
    g = I.Guard("s", "A", I.HmacSigner(b"k"), I.Witness(), ["id", "agent", "importance"])
    with pytest.raises(I.IntegrityError):
        g.verified(df)
    c = g.seal(df)
    assert I.Checkpoint.from_json(c.to_json()) == c and g.verified(df).count() == 2
    with pytest.raises(I.IntegrityError):
        I.Checkpoint.from_json(c.to_json().strip())
    with pytest.raises(I.IntegrityError):
        g.verified(df.withColumn("importance", F.lit(1)))
    g.seal(df.filter("id <> 2"))
    with pytest.raises(I.WitnessConflict):
        g.witness.advance(c)


def test_agents(spark):
    n = lambda *v: spark.range(1).select(A.ocean_narrative(*[F.lit(x) for x in v]).alias("x")).first()["x"]
    assert n(0.8, 0.9, 0.6, 0.7, 0.2).startswith("Soy extremadamente meticuloso") and ", y selectivo" in n(0.8, 0.9, 0.6, 0.7, 0.2)
    d = lambda a, b, c=0.05: spark.range(1).select(A.drift(F.lit(a), F.lit(b), c).alias("x")).first()["x"]
    assert (d(0.5, 0.9), d(0.5, 0.9, 0), d(0.02, -1.0)) == (0.55, 0.55, 0.0)
    rules = spark.createDataFrame([("A", "a", "c1", "high", True, 1), ("A", "b", "c2", "normal", True, 2), ("A", "c", "c3", "critical", True, 3), ("A", "d", "c4", "normal", False, 0)], "agent string, rule_key string, content string, priority string, active boolean, created_at int")
    assert [r.rule_key for r in A.rules_list(rules).orderBy("rank").collect()] == ["b", "a", "c"]
    log = spark.createDataFrame([("A", 1, "p", None), ("A", 2, None, "b"), ("A", 3, "q", None)], "agent string, seq int, personality string, boot_context string")
    assert tuple(A.partial_upsert(log, ["agent"], ["personality", "boot_context"]).first()) == ("A", "q", "b")


def test_contract(spark):
    df = schema.with_defaults(spark.createDataFrame([(1, "A", "x", "{bad")], "id long, agent string, content string, metadata string").withColumn("created_at", F.current_timestamp()), "memories")
    r = df.first()
    assert (r.category, r.importance, r.metadata, r.relevance_score) == ("fact", 5, "{}", 1.0)
    assert {x.column for x in schema.contract_diff(spark, df.drop("scope").schema, schema.TABLES["memories"]).collect()} == {"scope"}
    with pytest.raises(RuntimeError):
        schema.check_contract(df.drop("scope"), "memories")


def test_nothing_needs_the_optional_operators():
    code = "import sys; sys.modules['recollect.llm'] = None; sys.path.insert(0, '.'); import recollect.plans.catalog, recollect.agent, recollect.cli, recollect.streaming.activity"
    subprocess.run([sys.executable, "-c", code], check=True)
