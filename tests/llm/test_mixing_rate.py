import logging
import random
from collections import defaultdict

from recollect.llm import mixing as M

SCHEMA = "doc_id long, source string, lang string, topic string, tokens long"


def rows_of(rnd, n):
    return [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["x", "x", "y"]), rnd.choice(["p", "q"]), rnd.randrange(0, 100)) for i in range(n)]


def expected(out):
    return sum(r.probability * r.tokens for r in out)


def test_a_tiny_level_scales_down_no_other(spark, caplog):
    rows = rows_of(random.Random(4), 600)
    plain = {r.doc_id: r.probability for r in M.mix(spark.createDataFrame(rows, SCHEMA), rate=0.5).collect()}
    with caplog.at_level(logging.WARNING):
        out = M.mix(spark.createDataFrame([*rows, (9999, "tiny", "x", "p", 2)], SCHEMA), rate=0.5).collect()
    total = sum(r[4] for r in rows) + 2
    assert abs(expected(out) / total - 0.5) < 1e-6 and "source tiny: 2 of " in caplog.text
    assert all(0 <= r.probability <= 1 for r in out)
    assert all(r.probability > 1 - 1e-6 for r in out if r.doc_id == 9999)
    assert max(abs(r.probability - plain[r.doc_id]) for r in out if r.doc_id != 9999) < 0.05


def test_margins_get_their_share_of_the_budget(spark):
    rows = rows_of(random.Random(5), 600)
    out = M.mix(spark.createDataFrame(rows, SCHEMA), rate=0.3).collect()
    total = sum(r[4] for r in rows)
    for k, m in enumerate(M.MARGINS):
        have, got = defaultdict(float), defaultdict(float)
        for r in out:
            have[r[m]] += r.tokens
            got[r[m]] += r.probability * r.tokens
        z = sum(v ** M.TEMPER[m] for v in have.values())
        for level, v in have.items():
            assert abs(got[level] - 0.3 * total * v ** M.TEMPER[m] / z) < 1e-5 * total, (k, level)


def test_rate_at_the_ends(spark):
    df = spark.createDataFrame([(1, "a", "x", "p", 3), (2, "b", "x", "p", 3), (None, "a", "x", "q", 0)], SCHEMA)
    assert {r.doc_id: r.probability for r in M.mix(df, rate=1.0).collect()} == {1: 1.0, 2: 1.0, None: 0.0}
    assert M.mix(df.limit(0), rate=0.5).collect() == []
