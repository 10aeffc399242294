import hashlib
import re

from recollect.llm import decontamination as D
from recollect.llm import sharding as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, width=10):
    win = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - width + 1) if w else 0):
            win.setdefault(tuple(w[p : p + width]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for s, who in win.items():
            for p in range(len(w) - len(s) + 1):
                if tuple(w[p : p + len(s)]) == s:
                    hit.update(range(p, p + len(s)))
                    ids |= who
        named = ",".join(sorted(str(x) for x in ids if x is not None))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    body = [f"word{i}" for i in range(40)]
    items = [(1, " ".join(body[:25])), (2, "Short Item"), (3, None), (4, "..."), (None, "nobody asks this"), (12, " ".join(body[5:20])), (1, "also under one"), (7, "é è ê " * 5)]
    docs = [(1, " ".join(body)), (2, "x " + "; ".join(body[3:13]).upper() + " y"), (3, " ".join(body[3:12])), (4, None), (5, ""), (6, "a short-item here, nobody asks this"), (6, "a short-item here"), (None, "short item short item"), (9, "é è ê " * 50), (10, "word1 " * 5000), (11, "pad " * 100_000 + "Short Item")]
    d = spark.createDataFrame([(*x, 0, 1) for x in docs], "doc_id long, text string, n_hit int, hits int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, word int")
    assert sorted([tuple(r)[:6] for r in D.decontaminate(d, b).collect()], key=repr) == brute(docs, items)
    assert D.decontaminate(d.limit(0), b).count() == 0
    assert D.decontaminate(d, b.limit(0)).filter("contaminated").count() == 0


def test_many_windows_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 3)
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(10)]
    docs = [(0, " ".join(f"w{j}" for j in range(18))), (1, "w1 w2")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted([tuple(r)[:6] for r in D.decontaminate(d, b).collect()], key=repr) == brute(docs, items)


def test_sharding(spark):
    rows = [(i, f"text {i % 50} ü") for i in range(3000)] + [(None, None), (5, "text 5 ü"), (5, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    tree = S.even_tree(16)
    out = S.shard_documents(df, tree, S.add_shard(tree, 16)).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(120 < len(v) < 260 for v in slots.values()) and 100 < sum(r.grown_shard == 16 for r in out) < 260
    import zlib

    by = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) and r.size == len((by[r.doc_id] or "").encode()) + 1 for r in out if r.doc_id != 5)
    assert S.shard_documents(df.limit(0), tree).count() == 0


def test_weights_move_rows_only_between_changed_subtrees(spark):
    leaf = lambda i, w: S.Node(f"s{i}", own_weight=w, shard=i)
    a = S.Node("", (S.Node("g0", (S.Node("r0", (leaf(0, 1.0), leaf(1, 1.0))),)), S.Node("g1", (S.Node("r1", (leaf(2, 1.0), leaf(3, 1.0))),))))
    b = S.Node("", (S.Node("g0", (S.Node("r0", (leaf(0, 2.0), leaf(1, 1.0))),)), a.children[1]))
    df = spark.range(2000).selectExpr("id as doc_id", "'' as text")
    for r in S.shard_documents(df, a, b).filter("shard <> grown_shard").collect():
        assert r.grown_shard in (0, 1) and not (r.shard == 0 and r.grown_shard == 1)
