from recollect.llm import langid as L


def greedy(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_match_a_plain_parse():
    m = L.Model({"a": "the cat sat on the mat and the rat", "b": "der hund und die katze"})
    text = "the dog and the katze sat under die mat xyz"
    import numpy as np

    codes = L.encode(text, m.lut)
    for k, sample in (("a", "the cat sat on the mat and the rat"), ("b", "der hund und die katze")):
        plain = greedy("".join(map(chr, codes + 60)), "".join(map(chr, L.encode(sample, m.lut) + 60)))
        one = np.ones(1, np.int32)
        n, end = m.parse(np.asarray(codes)[:, None], m.tables[m.langs.index(k)], one == 1, one)
        assert n[0] + (end[0] != 1) == plain


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert out and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 7, "t"), (2, "", "x", 7, "t"), (3, "12 34 !!", "x", 7, "t"), (4, "abc " * 200_000, "x", 7, "t")], "doc_id long, text string, lang_pred string, score int, _text string")
    assert L.identify(df, {"a": "abc"}).select("_text").distinct().collect()[0][0] == "t"
    got = {r.doc_id: r.lang_pred for r in L.identify(df, {"a": "abc abc", "b": "xyz"}, keep=["doc_id"]).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "a"}
    assert L.identify(df, {}, keep=["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert L.training_samples(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}
