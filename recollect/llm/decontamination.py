"""Benchmark decontamination by a prefix-filtered set join (operator 9): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of an item window.
WINDOW = 10
#: Windows (or words of the items) broadcast at once; at about 200 bytes each they stay under 20 MB. More are joined by a shuffle.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    """The words of a text in order; A-Z lower-cased, null and empty without words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(win, items): the distinct windows of all items, each with the ids that hold it, as structs since an id may be null."""
    w = items.select(F.struct(F.col(item_id).cast("string").alias("id")).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    win = w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(width)).alias("win"))
    return win.groupBy("win").agg(F.collect_set("item").alias("items"))


def contained_windows(docs: DataFrame, windows: DataFrame, scratch: Scratch, width: int = WINDOW, limit: int | None = None) -> DataFrame:
    """(dk, th, at, len, items): every occurrence of a window in a document.

    Words are ordered by how often the documents hold them. Containment of a whole window needs all of its words, so a
    prefix of one word is enough: the rarest. Documents are joined on it; the window must then fit around the word
    (length and position), and its words are compared in order. Up to `limit` words and windows are broadcast. More
    meet the documents' words in a shuffle, where a place brings only the words that a window around it could cover,
    so the documents are read once however many windows there are.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    words = docs.select("dk", "th", words_of(F.col("text")).alias("w"))
    vocabulary = scratch.write(windows.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    few = vocabulary.count() <= limit
    found = words.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if few else vocabulary, "word")
    counts = scratch.write(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    # The rarest word of each window (ties by text, then by place); a window with a word that no document has is not joined.
    places = windows.select("win", "items", F.posexplode("win").alias("at", "word")).join(F.broadcast(counts) if few else counts, "word", "left")
    rarest = places.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("key"), F.first("items").alias("items"))
    keys = scratch.write(rarest.filter("key.n > 0").select("win", "items", F.col("key.word").alias("word"), F.col("key.at").alias("off"), F.size("win").alias("len")), "keys")
    at = F.posexplode("w").alias("pos", "word")
    if keys.count() <= limit:
        cand = words.select("dk", "th", "w", F.lit(0).alias("base"), F.size("w").alias("size"), at).join(F.broadcast(keys), "word")
    else:
        near = words.select("dk", "th", "w", at).withColumn("base", F.greatest(F.col("pos") - width + 1, F.lit(0)))
        near = near.select("dk", "th", F.slice("w", F.col("base") + 1, F.lit(2 * width - 1)).alias("w"), "base", F.size("w").alias("size"), "pos", "word")
        cand = near.join(keys, "word")
    start = F.col("pos") - F.col("off")
    cand = cand.filter((start >= 0) & (start + F.col("len") <= F.col("size")))
    cand = cand.filter(F.slice("w", start - F.col("base") + 1, F.col("len")) == F.col("win"))
    return cand.select("dk", "th", start.alias("at"), "len", "items")


def contaminated(docs: DataFrame, items: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dk, th) of the documents, keyed as by `keyed`, that hold a window of any item, of null id too."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.write(item_windows(items, width=width), "windows")
    return scratch.write(contained_windows(keyed(docs, id_col, text_col), windows, scratch, width).select("dk", "th").distinct(), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hits (at, len, items).

    An item of fewer words than `width`, but not none, is one window; null and empty texts have no words, so such a
    document is never hit and such an item finds nothing. Texts of any length are searched whole. Repeated rows each
    get their result; items that repeat an id count once. Items of null id are searched like any other: together they
    count as one item, and are left out of items_sha256 alone. An empty table of documents gives no rows, one of items
    no hits. Columns of other names are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = keyed(docs, id_col, text_col)
    windows = scratch.write(item_windows(items, width=width), "windows")
    hits = scratch.write(contained_windows(d, windows, scratch, width).groupBy("dk", "th").agg(F.collect_set(F.struct("at", "len", "items")).alias("hits")), "hits")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1))))
    found = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))
    per = hits.select("dk", "th", "hits", F.size(covered).cast("long").alias("n_hit"), found.alias("found"))
    base = d.select("dk", "th", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    ids = F.array_sort(F.filter(F.transform("found", lambda x: x["id"]), lambda x: x.isNotNull()))
    return base.join(per, ["dk", "th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce(ids, F.array().cast("array<string>"))), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        "hits",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
gram AS (SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM pos CROSS JOIN lens WHERE p + n - 1 <= len(w)),
hit AS (SELECT gram.r, gram.p, gram.n, win.item_id FROM gram JOIN win ON gram.s = win.s AND gram.n = win.n),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(ids.n_items, 0) AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN ids ON d.r = ids.r
"""
