"""Ids in the order of the rows given, and token counts row by row."""

from pyspark.sql import functions as F
from recollect.agent import Agent
from recollect.functions import text as X


def test_remembered_rows_keep_their_order(spark, tmp_path):
    """Embedding deals a small table over all cores; the ids follow the order from before."""
    a = Agent(spark, "Ada", f"file://{tmp_path}/o")
    text = spark.range(60).orderBy("id").coalesce(1).select(F.format_string("text %03d", "id").alias("content"))
    ids = a.remember(text)
    got = {r["id"]: r["content"] for r in a.list(100).collect()}
    assert [got[i] for i in ids] == [f"text {i:03d}" for i in range(60)]


def test_token_counts_shuffle_only_rows_of_repeated_ids(spark):
    rows = [(1, "a b a"), (2, "A b"), (2, "b c"), (None, "x"), (None, "X y"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {tuple(r) for r in X.token_counts(df, "id", "content").collect()}
    assert got == {(1, 5, 4, "a", "b_a"), (2, 6, 5, "a", "c"), (None, 4, 3, "x", "y")}
    plan = X.token_counts(df.filter("id = 1 or id = 3"), "id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
