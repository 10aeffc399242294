import random
from collections import defaultdict

from recollect.llm import hamming_search as H
from recollect.llm import mixing as M


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_top_k_matches_brute_force(spark):
    rnd = random.Random(3)
    codes = [rnd.getrandbits(64) for _ in range(300)]
    codes += [codes[0]] * 20 + [codes[1] ^ (1 << b) for b in range(8)]
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(5, signed(codes[9])), (900, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    q = df.filter("id % 50 = 0 or id = 900")
    got = defaultdict(list)
    for r in H.top_k(df, q, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbour_id))
    for i in (0, 50, 100, 150, 200, 250, 300):
        c = codes[i]
        want = sorted(((c ^ (x % 2**64)).bit_count(), j) for j, x in rows if x is not None)[:7]
        assert got[i] == want
    assert set(got) == {0, 50, 100, 150, 200, 250, 300}


def test_top_k_small(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, -1)], "id long, code long")
    assert sorted(map(tuple, H.top_k(df, df.filter("id = 1"), 10).collect())) == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 62)]
    assert H.top_k(df.limit(0), df, 3).count() == 0 and H.top_k(df, df.limit(0), 3).count() == 0


def ipf(cells, targets):
    w = dict(cells)
    for _ in range(200):
        for k, t in enumerate(targets):
            s = defaultdict(float)
            for c, x in w.items():
                s[c[k]] += x
            w = {c: x * t[c[k]] / s[c[k]] if s[c[k]] else 0.0 for c, x in w.items()}
    return w


def test_mix_matches_plain_ipf(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice(["p", "q", "r"]), rnd.randrange(0, 50), "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long, sampled string")
    cells = defaultdict(float)
    for _, *c, n, _ in rows:
        cells[tuple(c)] += n
    targets = []
    for k in range(3):
        s = defaultdict(float)
        for c, x in cells.items():
            s[c[k]] += x
        power = (0.7, 0.7, 1.0)[k]
        z = sum(v**power for v in s.values())
        targets.append({key: v**power / z for key, v in s.items()})
    w = ipf(cells, targets)
    ratio = {c: w[c] / cells[c] if cells[c] else 0 for c in cells}
    top = max(ratio.values())
    out = M.mix(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.probability - ratio[(r.source, r.lang, r.topic)] / top) < 1e-6
    assert 0 < sum(r.sampled for r in out) <= len(rows)


def test_mix_empty_and_unlisted(spark):
    schema = "doc_id long, source string, lang string, topic string, tokens long"
    assert M.mix(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, "a", "x", "p", 3), (2, "b", "x", "p", 3), (None, "a", "x", "p", 0)], schema)
    t = {"source": spark.createDataFrame([("a", 1.0)], "level string, share double"), "lang": spark.createDataFrame([("x", 1.0)], "level string, share double"), "topic": spark.createDataFrame([("p", 2.0)], "level string, share double")}
    assert {r.doc_id: r.probability for r in M.mix(df, t).collect()} == {1: 1.0, 2: 0.0, None: 1.0}


def test_clashing_names(spark):
    rows = [(i, "a", "x", "p", 5, "own") for i in range(20)]
    names = ("_source", "_lang", "_topic", "_cell", "_level", "t_source", "probability", "level", "w")
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long, note string")
    for n in names:
        df = df.withColumn(n, df["note"])
    for rate in (None, 0.5):
        out = M.mix(df, rate=rate)
        assert len(out.columns) == len(set(out.columns)) and out.filter("_source = 'own' and _cell = 'own' and w = 'own'").count() == 20
    codes = spark.createDataFrame([(1, 5, 1, 2, 3, 4), (2, 5, 1, 2, 3, 4)], "id long, code long, query_id long, distance int, segment int, tie int")
    assert sorted(map(tuple, H.top_k(codes, codes.filter("id = 1"), 3).collect())) == [(1, 1, 1, 0), (1, 2, 2, 0)]


def test_long_and_null_texts_have_topics_and_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 400_000 + "a | b"), (4, "9" * 300_000), (5, "\t \n"), (6, "see x@y now")], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", M.topic_of(df["text"]), M.token_count(df["text"])).collect()}
    assert got == {1: ("prose", 0), 2: ("prose", 0), 3: ("table", 400_003), 4: ("numeric", 1), 5: ("prose", 0), 6: ("address", 3)}
