"""op11 against a plain version: features by zlib and re, gains by math, the draw by sorting."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from recollect.llm import resampling as R

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(docs, bench, share=(5, 100), least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for _, x in docs:
        for g in grams(x)[0]:
            s[bucket(g)] += 1
    for x in bench:
        for g in grams(x)[0]:
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        g, n = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(y)] for y in g)
        rows.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {}
    out = []
    for k, r in enumerate(able[: len(able) * share[0] // share[1]]):
        rank.setdefault(tuple(r), []).append(k + 1)
    for r in rows:
        left = rank.get(tuple(r))
        out.append((*r[:4], left.pop(0) if left else None))
    return sorted(out, key=str)


def _texts(n, seed=1):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "été", "x1", "niño", "the", "of", "漢字", "end", "ÀB", "z" * 70, "q" * 200]
    return [(" ".join(r.choice(words) + r.choice(["", ",", "-", "\n"]) for _ in range(r.randrange(60)))) for _ in range(n)]


def _frames(spark, docs, bench):
    d = spark.createDataFrame([(i, x, "score") for i, x in docs], "doc_id long, text string, score string")  # a column of the result's name
    return d, spark.createDataFrame([(x,) for x in bench], "text string")


@pytest.mark.parametrize("share", [(5, 100), (1, 2), (1, 1)])
def test_against_a_plain_draw(spark, share):
    docs = list(enumerate(_texts(120))) + [(7, None), (8, ""), (None, "a b c " * 10), (None, "a b c " * 10), (3, "again and again " * 9), (3, "again and again " * 9), (3, "again and again " * 9)]
    d, b = _frames(spark, docs, [*_texts(9, 2), None, ""])
    got = R.resample(d, b, share=share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, [*_texts(9, 2), None, ""], share)


def test_many_ranges_give_the_same_ranks(spark):
    docs = list(enumerate(_texts(150, 5)))
    d, b = _frames(spark, docs, _texts(5, 6))
    gain = R.gains(R.bucket_counts(d), R.bucket_counts(b))
    from pyspark.sql import functions as F

    w = R.weighed(d, gain, ["doc_id"]).withColumn("score", F.col("weight") + R.noise(F.col("doc_id"))).withColumn("eligible", F.col("n_words") >= 20)
    one, many = ({(r.doc_id, r.rank) for r in R.draw(w, (1, 2), n).collect()} for n in (10**6, 7))
    assert one == many and max(r for _, r in one if r) == sum(1 for _, r in one if r)


def test_blocks_cut_no_word(monkeypatch):
    texts = [*_texts(40, 3), "y" * 5000, "a b " * 700, None, "", "one"]
    whole = [(r.tolist(), c.tolist()) for _, r, c in R.features(pa.array(texts))]
    monkeypatch.setattr(R, "BLOCK", 97)
    parts = list(R.features(pa.array(texts)))
    assert len(parts) > 20
    assert sorted(zip(*whole[0], strict=True)) == sorted((a, b) for _, r, c in parts for a, b in zip(r.tolist(), c.tolist(), strict=True))
    want = sorted((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t)[0])
    assert sorted(zip(*whole[0], strict=True)) == want


def test_tournament_merges_runs():
    r = random.Random(3)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted((r.randrange(20), i) for i in range(r.randrange(6))) for _ in range(k)]
        assert list(R.tournament(runs)) == sorted(x for run in runs for x in run)


def test_empty(spark):
    d, b = _frames(spark, [], [])
    assert R.resample(d, b).collect() == []
    d, b = _frames(spark, [(1, "few words"), (None, None)], [])
    assert {(r.doc_id, r.n_features, r["rank"]) for r in R.resample(d, b).collect()} == {(1, 3, None), (None, 0, None)}
