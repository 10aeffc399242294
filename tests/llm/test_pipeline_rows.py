import corpus_pipeline as P
from recollect.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def test_rows_without_id_are_judged_one_by_one(spark, monkeypatch):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10)
    clean = [f"a clean text of number {i} that no benchmark holds" for i in range(60)]
    docs = spark.createDataFrame([(None, f"before {item} after", "en", "s", 1), (7, f"also {item}", "en", "s", 1)] + [(None, t, "en", "s", 1) for t in clean], SCHEMA)
    left = P.decontaminate(spark, docs, SF).collect()
    assert sorted(r.text for r in left) == sorted(clean)
    monkeypatch.setattr(mixing, "RATE", 0.5)
    taken = [r.text for r in P.mix(spark, spark.createDataFrame(left, SCHEMA), SF).collect()]
    assert 10 < len(taken) < 50 and len(set(taken)) == len(taken)


def test_an_id_of_several_texts_stands_for_each_group(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, c, "en", "s", 1), (9, c, "en", "s", 1), (None, b, "en", "s", 1)], SCHEMA)
    want = sorted([(1, a), (1, b), (1, c)])
    for stage in (P.near_duplicates, dict(P.STAGES)["near_duplicates"]):
        assert sorted((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()) == want
