import random

import numpy as np

from recollect.llm import langid as L


def greedy(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def words(rnd, first, letters, n):
    return [" ".join("".join(chr(first + rnd.randrange(letters)) for _ in range(2)) for _ in range(k)) for k in n]


def test_large_alphabets_are_told_apart():
    rnd = random.Random(1)
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    pools = {}
    for k in ("p", "q"):  # the same letters in other words
        shuffled = rnd.sample(chars, len(chars))
        pools[k] = ["".join(shuffled[i : i + 2]) for i in range(0, len(shuffled), 2)]
    text = lambda k, n: " ".join(rnd.choice(pools[k]) for _ in range(n))
    latin = "the cat sat on the mat and the rat ran off " * 40
    samples = {"p": text("p", 2000), "q": text("q", 2000), "en": latin, "el": words(rnd, 0x3B1, 24, [500])[0], "ar": words(rnd, 0x627, 20, [500])[0]}
    m = L.Model(samples)
    asked = [k for k in ("p", "q") for _ in range(20)]
    assert m.predict([text(k, 30) for k in asked])[0] == asked
    assert m.predict(["the rat sat on the cat", words(rnd, 0x3B1, 24, [30])[0], words(rnd, 0x627, 20, [30])[0]])[0] == ["en", "el", "ar"]


def test_rare_letters_parse_as_plain():
    rnd = random.Random(2)
    sample = "".join(chr(0x4E00 + rnd.randrange(200)) for _ in range(3000))
    m = L.Model({"a": sample, "b": "the cat"})
    text = sample[100:140] + "the" + chr(0x4E00 + 900) + sample[500:520] + sample[10:13]
    codes = L.encode(text, m.lut)
    for k, s in (("a", sample), ("b", "the cat")):
        plain = greedy("".join(chr(c + 60) for c in codes.tolist()), "".join(chr(c + 60) for c in L.encode(s, m.lut).tolist()))
        one = np.ones(1, np.int32)
        n, end = m.parse(np.asarray(codes)[:, None], m.tables[m.langs.index(k)], one == 1, one)
        assert n[0] + (end[0] != 1) == plain


def coded(text, alphabet):
    """Runs of other than letters as one mark, letters that no sample has as another."""
    out = []
    for c in text:
        x = (c.lower() if c.lower() in alphabet else "?") if c.isalpha() else "_"
        if x != "_" or not out or out[-1] != "_":
            out.append(x)
    return "".join(out)


def test_whole_predictions_match_a_plain_parse(monkeypatch):
    rnd = random.Random(3)
    first = {"zh": (0x4E00, 300), "ja": (0x3042, 70), "ko": (0xAC00, 300), "ru": (0x430, 32), "en": (0x61, 26), "fr": (0x61, 26)}
    pools = {k: [w for w in words(rnd, a, n, [1] * 120)] for k, (a, n) in first.items()}
    text = lambda k, n: " ".join(rnd.choice(pools[k]) + rnd.choice(["", ",", " 7 "]) for _ in range(n))
    samples = {k: text(k, 400) for k in pools}
    alphabet = {c.lower() for s in samples.values() for c in s if c.isalpha()}
    plain = {k: coded(s, alphabet) for k, s in samples.items()}
    cost = {k: np.log2(len(s)) for k, s in plain.items()}
    asked = [text(k, n) for k in pools for n in (1, 30, 400)] + [text("ru", 200) + text("zh", 300) + "\u05d0\u05d1" * 9, "\u05d0 x", "7 8 9"]
    want = []
    for t in asked:
        c = sorted((greedy(coded(t, alphabet), plain[k]) * cost[k], k) for k in sorted(plain))
        want.append((c[0][1], 1 - c[0][0] / c[1][0]) if any(x.isalpha() for x in t) else ("und", 0.0))
    m = L.Model(samples)
    for piece, lanes in ((256, 1 << 14), (7, 5), (1, 3)):  # how texts are cut shows in no result
        monkeypatch.setattr(L, "PIECE", piece)
        monkeypatch.setattr(L, "LANES", lanes)
        lang, score = m.predict(asked)
        assert lang == [x for x, _ in want]
        assert np.allclose(score, [x for _, x in want])
    got = m.predict([text(k, 40) for k in pools for _ in range(5)])[0]
    assert got == [k for k in pools for _ in range(5)]
