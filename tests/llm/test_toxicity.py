"""op12: held-out accuracy on the given labels, the machine against its formula, and unusual tables."""

import random
import zlib

import numpy as np
import pytest
from recollect.llm import toxicity as T


def test_held_out_documents_of_the_given_tables(spark):
    d = "/root/testdata/sf0.1"
    out = T.op12_toxicity(spark, d)
    assert [tuple(x) for x in out.dtypes] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert out.count() == 10_000
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted for r in held if r.toxic)
    assert hit / sum(r.toxic for r in held) > 0.85 and hit / sum(r.predicted for r in held) > 0.97


def _machine(n=6):
    r = np.random.default_rng(2)
    return T.Machine({h: i for i, h in enumerate(range(n))}, 0.3, r.normal(size=n + T._SIZES), r.normal(size=(n + T._SIZES, T.FACTORS)))


def test_scores_are_those_of_all_pairs():
    m = _machine()
    rows = [[0, 2, 8], [7], [0, 1, 2, 3, 4, 5, 9]]
    z = m.sums(rows)[0]
    for r, got in zip(rows, z, strict=True):
        want = m.bias + sum(m.weight[i] for i in r) + sum(m.factor[i] @ m.factor[j] for a, i in enumerate(r) for j in r[a + 1 :])
        assert got == pytest.approx(want)


def test_insult_beside_a_mention_is_learnt_as_a_pair(spark):
    """Neither word says anything alone: only a text with both (or with neither) is toxic."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(1600):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(["some", "more", "plain", "filling"]) for _ in range(10)] + ["zzqxv"] * a + ["kkwpt"] * b
        r.shuffle(words)
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(a == b)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    want = dict(labels)
    strong, T.STRONG = T.STRONG, 0.0
    try:
        got = [r for r in T.toxicity(d, lab).collect() if r.held_out]
    finally:
        T.STRONG = strong
    assert sum((r.score > 0.5) == want[r.doc_id] for r in got) / len(got) > 0.95


def test_unusual_rows(spark):
    docs = [(1, "x " * 20_000), (2, None), (3, ""), (None, "idiot"), (3, "idiot idiot"), (3, "idiot idiot"), (4, "1 2 3 !!!")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.toxicity(d, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    out = T.toxicity(d, odd).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
    assert T.toxicity(d.limit(0), odd).collect() == []
