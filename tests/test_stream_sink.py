"""Streams into the store: a batch that is repeated changes nothing, and memories are routed once."""

from pyspark.sql import functions as F
from recollect.sources.providers import HashEmbedder
from recollect.sources.store import Store
from recollect.streaming import activity


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s").initialize()
    src = f"{tmp_path}/in"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", F.lit("A").alias("agent"), F.lit("t").alias("thought"), F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(src)
    stream = activity.read_events(spark, src, "id long, agent string, thought string, created_at timestamp", 1)
    sink, fails = activity.store_sink(s, "inner_monologue", "x"), []

    def breaks(batch, number):
        sink(batch, number)
        if number == 1 and not fails:
            fails.append(number)
            raise OSError("lost after the commit")

    q = activity.apply_batches(stream, breaks, f"file://{tmp_path}/c")
    try:
        q.awaitTermination(120)
    except Exception:
        pass
    assert fails and s.current("inner_monologue").count() < 30
    activity.into_store(stream, s, "inner_monologue", "x", f"file://{tmp_path}/c").awaitTermination(120)
    assert sorted(r.id for r in s.current("inner_monologue").collect()) == list(range(30))
    assert len(s._state("inner_monologue")[1]["batches"]) == 3  # batch 1 was given twice and stored once


def test_memories_are_routed_by_what_is_known(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/m").initialize()
    apply = activity.routed(s, HashEmbedder(), "m")
    rows = lambda *x: spark.createDataFrame([(i, "A", t, u, 8) for i, t, u in x], "id long, agent string, content string, utility_score double, importance int").withColumn("created_at", F.current_timestamp())
    apply(rows((1, "the server is down", 0.1)), 0)
    for _ in range(2):
        apply(rows((2, "the server is down", 0.1), (3, "tea with honey", 0.1), (4, "the server is down", 0.9)), 1)
    got = {r.id: r.importance for r in s.current("memories").collect()}
    assert got == {1: 8, 2: 4, 3: 8, 4: 8}


def test_foreign_tables_tell_no_secrets(spark, tmp_path):
    import pytest
    from recollect.sources import providers as P

    url = "jdbc:none://host/db?user=me&password=hunter2"
    df = spark.createDataFrame([(1, [0.5, 2.0])], "id long, v array<float>")
    for action in (lambda: P.read_jdbc(spark, url, "t"), lambda: P.write_jdbc(df, url, "public.t")):
        with pytest.raises(P.SourceError) as e:
            action()
        assert "hunter2" not in str(e.value) and "host" not in str(e.value) and e.value.__cause__ is None and e.value.__suppress_context__
    for bad in ("t; drop table x", "a.b.c", "1t", "t t", "", 'a"b', "é"):
        with pytest.raises(ValueError):
            P.write_jdbc(df, url, bad)
    with pytest.raises(ValueError):
        P.write_jdbc(df.withColumnRenamed("v", "v w"), url, "t")


def test_values_and_copies_of_the_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/v").initialize()
    assert s.fetch_value(s.current("rules").select("content")) is None
    s.append("rules", spark.createDataFrame([(1, "A", "k", "x")], "id long, agent string, rule_key string, content string"))
    assert s.fetch_value(s.current("rules").select("content")) == "x"
