"""op13 against a plain version: every two words compared."""

import random
import re
import zlib
from collections import Counter

from recollect.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, every=199):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    nears = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in nears.items():
        if xs and (best := min(xs, key=lambda x: (-n[x], x))) and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(nears[w]), n.get(form.get(w))) for w, c in n.items()) if n else []


def _docs(seed=2, n=60):
    r = random.Random(seed)
    base = ["letter", "lettres", "banana", "bananas", "aaaaaaa", "ÉCOLEété", "straße", "göttin", "mississippi", "x" * 300]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = r.choice(base[: 1 + int(len(base) * r.random() ** 2)])
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abÀz") + w[at:], w[:at] + r.choice("aß×") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.2 else w)
        docs.append((i if i % 9 else None, r.choice([" ", ", ", "中", "-"]).join(words)))
    docs += [(100 + i, " ".join(["abcdefgh"] * 40 + ["abcdefgx"] * 6 + ["abcdefyx"])) for i in range(6)]  # a chain of two links
    return [*docs, (5, None), (6, ""), (7, docs[1][1]), (7, docs[1][1])]


def _rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_against_all_pairs(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, "word") for d in docs], "doc_id long, text string, word string")  # a column of the result's name
    want = plain(docs)
    assert _rows(S.variants(df)) == want
    assert len(want) > 40 and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert _rows(S.variants(df, every=3)) == plain(docs, 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(df).collect() == []
    assert S.variants(spark.createDataFrame([(1, None), (None, "short words")], "doc_id long, text string")).collect() == []
