import hashlib

import corpus_pipeline as P
from recollect.llm import decontamination as D

ITEMS = [(None, "nobody knows whose question this long leaked passage really is"), (None, "..."), (3, "short item")]
DOCS = [(1, "x nobody knows whose question this long leaked passage really is y"), (2, "a short item"), (3, "clean")]


def test_items_without_id_are_searched(spark, tmp_path):
    d = spark.createDataFrame([(*x, "en", "s", 1) for x in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(d, b).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (10, 1, sha(""), True), 2: (2, 1, sha("3"), True), 3: (0, 0, sha(""), False)}
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in P.decontaminate(spark, d, str(tmp_path)).collect()] == [3]
