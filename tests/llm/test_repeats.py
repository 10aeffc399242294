import hashlib
import random
from functools import partial
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from recollect.llm import substring_dedup as S
from recollect.llm import suffix_dedup as X


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "ß", "naïve"]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.choice([30, 36, 60]))) for _ in range(4)]
    out = []
    for i in range(60):
        t = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 5, 34, 35, 90])))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            t += rnd.choice([" ", "\n"]) + rnd.choice(passages)
        out.append((i, t))
    return [*out, (60, None), (61, ""), (62, out[3][1]), (63, "aaaa " * 60), (64, "a" * 300), (65, "a" * 300), (None, out[7][1]), (7, out[7][1]), (5, out[9][1])]


def brute_words(rows, win=35):
    at = defaultdict(int)
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in docs:
        for p in range(len(w) - win + 1):
            at[tuple(w[p : p + win])] += 1
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - win + 1):
            if at[tuple(w[p : p + win])] > 1:
                gone.update(range(p, p + win))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for q, x in enumerate(w) if q not in gone)).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, n=50):
    first = {}
    rank = lambda i: 2**63 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            first[s] = min(first.get(s, 2**63), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < rank(i):
                gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, dk int, spans int")
    got = S.remove_repeats(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == brute_words(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and sum(s["len"] for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, dk int, spans int")
    got = X.remove_later_copies(df).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute_bytes(rows)


@pytest.mark.parametrize("seed", range(20))
def test_previous_factors_match_brute_force(seed):
    rnd = np.random.default_rng(seed)
    n, width, length = int(rnd.integers(0, 300)), 12, int(rnd.integers(1, 5))
    rows = rnd.integers(0, rnd.integers(2, 4), (n, width)).astype(np.uint8)  # byte 0 is also what pads
    need = rnd.integers(length, width + 1, n)
    rows[np.arange(width) >= need[:, None]] = 0
    rows, need, key = X._sorted(rows, need, rnd.integers(0, rnd.integers(1, 60), n)) if n else (rows, need, need)
    got = X.previous_factors(rows, need, key, length)
    for i in range(n):
        best = 0
        for j in np.flatnonzero(key < key[i]):
            m = min(need[i], need[j])
            same = rows[i, :m] == rows[j, :m]
            best = max(best, m if same.all() else int(same.argmin()))
        assert got[i] == (best if best >= length else 0)


def test_long_texts_and_chunk_borders(spark):
    rnd = random.Random(9)
    line = lambda n: "".join(rnd.choice("abcdefgh \x00") for _ in range(n))
    a = line(560_000)
    rows = [(3, a), (4, line(100) + a[262_000:262_300] + line(50)), (9, line(300_000) + a[100_000:101_000] + line(49)), (1, a[400_000:400_120]), (12, "z" * 270_000), (13, "y" * 49 + "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.remove_later_copies(df, with_text=False).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute_bytes(rows)


@pytest.mark.parametrize("hot", [1, 7])
def test_hot_seeds_and_many_ranges(spark, monkeypatch, hot):
    """A seed in all texts among other surroundings, sorted out without holding its occurrences, over many ranges."""
    rnd = random.Random(hot)
    some = lambda n: "".join(rnd.choice("ab") for _ in range(n))
    passage = "the same twenty bytes everywhere, and a little more of it"
    rows = [(i, some(rnd.randrange(40)) + passage[: rnd.randrange(20, len(passage))] + some(rnd.randrange(40))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + rows[i + 1][1]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(X, "candidates", partial(X.candidates, hot=hot))
    monkeypatch.setattr(S, "candidates", partial(S.candidates, hot=hot))
    monkeypatch.setattr(X, "repeated_suffixes", partial(X.repeated_suffixes, range_bytes=2000))
    got = X.remove_later_copies(df, with_text=False).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute_bytes(rows)
    words = [(i, " ".join(t)) for i, t in rows]
    got = S.remove_repeats(spark.createDataFrame(words, "doc_id long, text string").repartition(7), with_text=False).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == brute_words(words)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).collect() == [] and X.remove_later_copies(df).collect() == []


def test_small_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert sorted([tuple(r) for r in X.op10_suffix_dedup(spark, sf).collect()], key=repr) == brute_bytes(rows)
    assert sorted([tuple(r) for r in S.op5_substring_dedup(spark, sf).collect()], key=repr) == brute_words(rows)
