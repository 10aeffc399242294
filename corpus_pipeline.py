"""A training corpus in five stages, each by one operator: language, near-duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents;
the last returns where each document goes. `run` writes every stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontamination, langid, mixing, sharding, simhash
from recollect.llm import near_copies as similar
from recollect.llm.common import MAX_LONG, Scratch, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too); `lang` becomes the language found in the others.

    Rows are judged one by one, so null ids and repeats change nothing.
    """
    docs = _columns(docs)
    found = langid.identify(docs, langid.training_samples(docs), keep=list(COLUMNS)).filter(F.col("lang_pred") != langid.UND)
    return Scratch(spark).write(found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS), "language")


def _rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of docs for each key (dk, th) of `keep`."""
    keep = keep.select(F.col("dk").alias("_kd"), F.col("th").alias("_kt"))
    rows = docs.withColumn("_dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG))).withColumn("_th", text_key(F.col("text")))
    rows = rows.join(keep, (F.col("_dk") == F.col("_kd")) & (F.col("_th") == F.col("_kt")), "left_semi")
    return _columns(rows.dropDuplicates(["_dk", "_th"]))


def _unlinked(docs: DataFrame) -> DataFrame:
    """(dk, th) of the row that stays of each group of linked fingerprints."""
    key = F.struct(F.coalesce("doc_id", F.lit(MAX_LONG)).alias("dk"), "th")
    return simhash.near_duplicates(docs).groupBy("root").agg(F.min(key).alias("k")).select("k.dk", "k.th")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one of the smallest id.

    Of several rows of that id in the group one stays (the text of the smallest key); null ids come last.
    """
    return _rows(docs, _unlinked(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What near_duplicates keeps, without documents that share 0.8 or more of their five-word shingles with one that stays."""
    keep = Scratch(spark).write(_unlinked(docs), "unlinked")
    return _rows(docs, similar.without_near_copies(docs, keep))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item, row by row: ids, null ones too, decide nothing.

    Null and empty texts hold none and stay; of rows that repeat each is judged by its own text.
    """
    hit = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("dk").alias("_kd"), F.col("th").alias("_kt"))
    return _columns(docs.join(hit, (F.coalesce(docs["doc_id"].cast("long"), F.lit(MAX_LONG)) == F.col("_kd")) & (text_key(docs["text"]) == F.col("_kt")), "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by the probabilities that bring source, language and topic to their target shares.

    A document without an id is drawn by its text; rows that repeat an id are drawn together. Null sources and languages
    are levels of their own; texts without a word have no weight and are not drawn.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), text_key(F.col("text"))).alias("_key")
    rows = docs.select(*COLUMNS, key, mixing.topic_of(F.col("text")).alias("topic"), mixing.token_count(F.col("text")).alias("tokens"))
    return _columns(mixing.mix(Scratch(spark).write(rows, "tokens"), rate=mixing.RATE, id_col="_key").filter("sampled"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; null ids and repeated rows have places like any other."""
    tree = sharding.even_tree(sharding.SHARDS)
    return sharding.shard_documents(docs, tree, sharding.add_shard(tree, sharding.SHARDS))


STAGES = [("language", language), ("near_duplicates", near_copies), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Language identification and SimHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
