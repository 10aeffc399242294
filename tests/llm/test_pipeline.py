import corpus_pipeline as P
from recollect.llm import decontamination, langid, sharding, simhash


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (None, "the same old text again and again", None, None, 3), (None, "the same old text again and again", None, None, 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    a = P.language(spark, docs, sf).cache()
    assert a.columns == list(P.COLUMNS) and a.count() == docs.count() - 2
    b = P.near_duplicates(spark, a, sf).cache()
    named = simhash.near_duplicates(a).collect()
    assert sorted(r.doc_id for r in b.collect() if r.doc_id is not None) == sorted({r.component_id for r in named if r.component_id is not None})
    assert b.filter("doc_id is null").count() == 1
    c = P.decontaminate(spark, b, sf).cache()
    bad = {r.doc_id for r in decontamination.decontaminate(b, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
    assert bad and {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect()} - bad
    d = P.mix(spark, c, sf).cache()
    ids = {r.doc_id for r in d.collect()}
    assert ids and ids <= {r.doc_id for r in c.collect()} and d.columns == list(P.COLUMNS)
    e = P.shard(spark, d, sf).collect()
    assert len(e) == d.count() and {r.shard for r in e} <= set(range(sharding.SHARDS))
    assert langid.UND not in {r.lang for r in d.collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []
