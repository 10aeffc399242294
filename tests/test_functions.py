import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import scoring as S
from recollect.functions import text as X


def one(spark, col, **values):
    return spark.range(1).select(col.alias("x")).first()["x"]


def plain_tokens(t):
    w = re.findall(r"\w+", t.lower())
    return w + [f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)]


@pytest.mark.parametrize("text", ["", "one", "Straße und Füße, 2 mal!", "I love Python programming", "naïve café x_y"])
def test_hash_embedding_matches_its_definition(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, content string")
    want = [0] * 128
    for t in plain_tokens(text):
        h = hashlib.md5(t.encode()).hexdigest()
        want[int(h[:8], 16) % 128] += 1 if int(h[8:10], 16) % 2 == 0 else -1
    assert X.hash_embed(df, "id", "content").first()["counts"] == want
    v = X.hash_embed(df, "id", "content").select(X.normalised(F.col("counts")).alias("v")).first()["v"]
    assert math.isclose(sum(x * x for x in v), 1.0 if any(want) else 0.0, abs_tol=1e-5)


def test_contextualize(spark):
    ctx = F.array(F.lit("OLD"), F.lit("  "), F.lit("newest"))
    assert one(spark, X.contextualize(F.lit(" q "), ctx, 6)) == "newest\nq"
    assert one(spark, X.contextualize(F.lit("q"), ctx)) == "OLD\nnewest\nq"
    assert one(spark, X.contextualize(F.lit("q"), ctx, 0)) == one(spark, X.contextualize(F.lit("q"), None)) == "q"
    with pytest.raises(ValueError):
        X.contextualize(F.lit("q"), ctx, -1)


def test_entities(spark):
    t = "We met William Tovar, of SEAL and HIPAA; \"a phrase\" and 'other one' and seal. ÑAND"
    got = {(r.entity, r.entity_type) for r in X.extract_entities(spark.createDataFrame([(1, t)], "id long, t string"), ["id"], "t").collect()}
    assert got == {("William Tovar", "person_or_place"), ("SEAL", "acronym"), ("HIPAA", "acronym"), ("a phrase", "reference"), ("other one", "reference")}


@pytest.mark.parametrize(("category", "content", "want"), [("correction", "x", "technical"), ("fact", "the API is down", "technical"), ("fact", "I feel proud", "emotional"), ("procedure", "first step", "procedural"), ("procedure", "x", "technical"), ("fact", "my pipeline", "procedural"), ("fact", "nothing", "general"), ("fact", "important", "technical")])
def test_domains(spark, category, content, want):
    assert one(spark, X.classify_domain(F.lit(category), F.lit(content))) == want


def test_contradiction(spark):
    assert one(spark, X.contradiction(F.lit("it is wrong"), F.lit("it is right"))) == "wrong"
    assert one(spark, X.contradiction(F.lit("same"), F.lit("same"))) is None


def score(spark, days, importance=5, category="fact", valence=0.0, arousal=0.0):
    return one(spark, S.decay_score(F.lit(0.8), F.lit(category), F.lit(importance), F.lit(valence), F.lit(arousal), F.lit(0.5), F.lit(1.0), F.lit(float(days))))


def test_decay(spark):
    assert score(spark, 0) > score(spark, 60) > 0
    assert math.isclose(score(spark, 60), score(spark, 0) / 2)
    assert score(spark, 1000, 10) > 0.99 * score(spark, 0, 10)
    assert math.isclose(score(spark, 180, 8, "emotion"), score(spark, 0, 8, "emotion") / 2)
    assert score(spark, 2, category="emotion", valence=-0.9) > score(spark, 2, category="emotion")
    assert one(spark, S.half_life(F.lit("unknown"))) == 30


def test_small_rules(spark):
    assert one(spark, S.grown_confidence(F.lit(0.5))) == 0.55
    assert one(spark, S.success_rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, X.slug(F.lit(" My Agent! "))) == "My-Agent"
    assert one(spark, X.has_secret(F.lit("key sk-" + "a" * 24))) and not one(spark, X.has_secret(F.lit("risk-averse")))
