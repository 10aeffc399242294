import random
from itertools import combinations

import corpus_pipeline as P
from recollect.llm import near_copies as N


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_no_near_copies_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stage = dict(P.STAGES)["near_duplicates"]
    kept = {r.doc_id: r.text for r in stage(spark, docs, "").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for a, b in ((709, 944), (643, 770), (582, 875), (255, 278), (255, 991)):
        assert jaccard(text[a], text[b]) >= 0.8 and not (a in kept and b in kept)
    sets, holders = {i: grams(t) for i, t in kept.items()}, {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    assert pairs and all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8 for a, b in pairs)
    linked = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert set(kept) <= linked
    for i in linked - set(kept):  # nothing goes without a reason
        assert any(j < i and jaccard(text[i], text[j]) >= 0.8 for j in linked)


def test_pairs_that_miss_the_bucket_leader_are_compared(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    y = base[:380] + [f"y{i}" for i in range(20)]
    z = base[20:380] + [f"y{i}" for i in range(20)] + [f"z{i}" for i in range(15)]
    far = base[:300] + [f"q{i}" for i in range(100)]
    rows = [(1, " ".join(far)), (2, " ".join(y)), (3, " ".join(z)), (4, "one two"), (None, "one two"), (5, "")]
    assert jaccard(rows[0][1], rows[1][1]) < 0.8 and jaccard(rows[1][1], rows[2][1]) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from recollect.llm.common import keyed

    keys = keyed(df).select("dk", "th")
    out = keyed(df).join(N.without_near_copies(df, keys), ["dk", "th"], "left_semi").collect()
    assert {1, 2, 5} <= {r.doc_id for r in out} and 3 not in {r.doc_id for r in out}


def _keep(spark, rows):
    from recollect.llm.common import keyed

    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in keyed(df).join(N.without_near_copies(df, keyed(df).select("dk", "th")), ["dk", "th"], "left_semi").collect()}


def test_only_what_is_near_one_that_stays_goes(spark):
    base = [f"w{i}" for i in range(400)]
    a = base
    b = [f"b{i}" for i in range(28)] + base[28:]
    c = b[:-28] + [f"c{i}" for i in range(28)]
    a, b, c = (" ".join(x) for x in (a, b, c))
    assert jaccard(a, b) >= 0.8 and jaccard(b, c) >= 0.8 and jaccard(a, c) < 0.8
    assert _keep(spark, [(1, a), (2, b), (3, c)]) == {1, 3}
    assert _keep(spark, [(2, a), (1, b), (3, c)]) == {1}
    assert _keep(spark, [(1, None), (2, ""), (3, "?")]) == {1, 2, 3}


def test_groups_against_a_plain_loop(spark):
    """A hundred versions of one text, each some edits from another: what stays is what a loop over all pairs keeps."""
    rnd = random.Random(5)
    made = [[f"w{i}" for i in range(300)]]
    for n in range(100):
        t = list(rnd.choice(made))
        for _ in range(rnd.randrange(1, 12)):
            t[rnd.randrange(len(t))] = f"n{n}x{rnd.randrange(10**6)}"
        made.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    rnd.shuffle(rows)
    stays: list = []
    for i, t in sorted(rows):
        if not any(jaccard(t, x) >= 0.8 for _, x in stays):
            stays.append((i, t))
    assert _keep(spark, rows) == {i for i, _ in stays} and 1 < len(stays) < 60


def test_of_a_bucket_only_pairs_that_agree_become_rows(spark, monkeypatch):
    """Many texts alike but far under 0.8 in one bucket: compared where they are, whatever the parts."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for p in rnd.sample(range(120), 4):
            t[p] = f"n{i}x{p}"
        rows.append((i, " ".join(t)))
    rows.append((60, rows[40][1] + " end"))
    written: dict = {}
    keep = N.Scratch.write
    monkeypatch.setattr(N.Scratch, "write", lambda self, df, name, **k: (out := keep(self, df, name, **k), written.__setitem__(name, out.count()))[0])
    monkeypatch.setattr(N, "ROUNDS", 1)
    monkeypatch.setattr(N, "PART", 16)
    stays: list = []
    for i, t in rows:
        if not any(jaccard(t, x) >= 0.8 for _, x in stays):
            stays.append((i, t))
    assert _keep(spark, rows) == {i for i, _ in stays} and len(stays) > 40
    assert written["pairs"] < 100
