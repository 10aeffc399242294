import random

import numpy as np
import xxhash

from recollect.llm import simhash as S


def brute(texts):
    out = {}
    for i, t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        grams = [b" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    return out


def components(fp):
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 4) for x in f]
    comp = np.arange(len(ids))
    while True:
        new = np.array([comp[n].min() for n in near], np.int64)
        if (new == comp).all():
            return {i: ids[c] for i, c in zip(ids, comp.tolist(), strict=True)}
        comp = new


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 60, 300]))) for _ in range(60)]
    texts = list(enumerate(base))
    for i, t in enumerate(base):
        w = t.split()
        w[rnd.randrange(len(w))] = "Changed"
        texts.append((100 + i, " ".join(w)))
    texts += [(200, None), (201, ""), (202, " \t\n"), (203, base[0].upper()), (204, base[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.near_duplicates(df).collect()}
    fp = brute(texts)
    assert {i: f for i, (f, _) in got.items()} == fp
    assert {i: c for i, (_, c) in got.items()} == components(fp)


def test_large_cells_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 64)
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([2, 3, 5, 8]))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(200)}
    ids = dict(enumerate(sorted(fps)))
    from recollect.llm.common import Scratch
    from recollect.operators.components import connected_components

    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    sc = Scratch(spark)
    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(S.linked(df, sc), sc).collect()}
    want = components(ids)
    groups = {}
    for i, f in ids.items():
        groups.setdefault(want[i], set()).add(f)
    have = {}
    for f in fps:
        have.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))


def test_hierarchy_finds_all_links_and_adds_up_differences():
    rnd = np.random.default_rng(4)
    for n, cells in ((0, 1), (1, 1), (2, 1), (9, 2), (600, 5), (900, 1)):
        centre = rnd.integers(0, 1 << 63, max(1, n // 100), np.uint64)
        fp = np.unique(np.concatenate([rnd.integers(0, 1 << 63, n // 3, np.uint64), centre[rnd.integers(0, len(centre), n - n // 3)] ^ (np.uint64(1) << rnd.integers(0, 64, n - n // 3, np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, n - n // 3, np.uint64))])) if n else np.empty(0, np.uint64)
        rank = fp.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        cell = rnd.integers(0, cells, len(fp))
        order = np.lexsort((rank, cell))
        fp, cell = fp[order], cell[order]
        got = {(i, j) for x, y in S.links(cell, fp) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
        want = {(i, j) for i, j in zip(*np.nonzero(near & (cell[:, None] == cell[None, :])), strict=True) if i < j}
        assert got == want
        if n:
            for low, up in zip(S.hierarchy(cell, fp), S.hierarchy(cell, fp)[1:], strict=False):
                for k in range(len(up.mask)):  # what a node shares, all below it share
                    assert all(up.mask[k] & ~low.mask[c] == 0 and (low.pattern[c] ^ up.pattern[k]) & up.mask[k] == 0 for c in range(up.child[k], up.end[k]))


def test_more_fingerprints_get_more_parts():
    assert [S.segments_for(n) for n in (0, 10**6, 10**8, 10**10, 10**13)] == [6, 6, 7, 8, 10]
    for s in (6, 7, 8, 10):
        assert len(S.masks(s)) == len(set(S.masks(s)))
        rnd = random.Random(s)
        for _ in range(200):  # any four bits leave a mask untouched
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(m & flips == 0 for m in S.masks(s))


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    fp = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    want = components(fp)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op3_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_very_long_text(spark):
    long = "one two three four five " * 60_000
    got = {r.doc_id: r.fp % 2**64 for r in S.near_duplicates(spark.createDataFrame([(1, long), (2, long + "six")], "doc_id long, text string")).collect()}
    assert got == brute([(1, long), (2, long + "six")])


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = S.near_duplicates(spark.createDataFrame([(None, "a"), (None, "a"), (3, "b c"), (3, "b c")], schema)).collect()
    assert len(rows) == 4 and {r.component_id for r in rows if r.doc_id is None} == {None}
