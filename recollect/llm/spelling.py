"""Spelling variants (operator 13): words one edit apart, found by a prefix filter over their rarest positional bigrams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .resampling import CRC_SQL, crc_sql

#: A letter is lost where this divides the CRC; words have at least so many code points and occurrences.
EVERY, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Bigrams of the prefix: one edit changes two at most, so of three the rarest that is left is in both prefixes.
PREFIX = 3
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000

_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch], every: int, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return b

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            # Latin-1 holds every letter of a run in one byte; all else becomes "?", and lower() changes A-Z alone.
            found = _RUN.findall((text.as_py() or "").encode("latin-1", "replace").lower())
            first = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(found).items():
                word = run.decode("latin-1")
                h = zlib.crc32(run if run.isascii() else word.encode(), first)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= least:
                    held[word] += n
            if len(held) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame, *, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of whole texts, some with a letter lost by a rule of id and word, that are long and common enough."""
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    n = rows.mapInArrow(lambda batches: _counted(batches, every, least_length), "word string, n long")
    return n.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _prefixes(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, len, gram, pos): of each word the PREFIX bigrams that are rarest among all words, ties by text and place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                n.update(map("".join, zip(w, w[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["gram", "n"])

    grams = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # Pairs of the alphabet's 90 letters: 8,100 at most.
    often = {r["gram"]: r["n"] for r in grams.collect()}

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, gram, pos = [], [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                for _, g, p in sorted((often[g], g, p) for p, g in enumerate(map("".join, zip(w, w[1:], strict=False))))[:PREFIX]:
                    at.append(i)
                    gram.append(g)
                    pos.append(p)
            own = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(gram, pa.string()), pa.array(pos, pa.int32())], ["word", "n", "len", "gram", "pos"])

    src = words.select("word", "n", F.length("word").alias("len"))
    return scratch.write(src.mapInArrow(rarest, "word string, n long, len int, gram string, pos int"), "prefixes", rows=10_000)


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, na, b, nb): every two words that are one edit apart, once.

    Of both words' bigrams, in one order by frequency and then by place, the first that the edit leaves is among the
    first three; so words meet on a bigram of these. Of equal lengths it stands at the same place in both, in the longer
    word also one place on. Such a pair is verified, first by its halves: the edit leaves one of them as it is.
    """
    p = _prefixes(words, scratch)
    size, at = F.col("len"), F.col("pos")
    halves = lambda h, skip: (F.hash(F.substring("word", F.lit(1), h)).alias("head"), F.hash(F.substring("word", h + 1 + skip, size)).alias("tail"))
    left = p.select(F.col("word").alias("a"), F.col("n").alias("na"), "gram", "len", "pos", *halves((size / 2).cast("int"), 0))
    one = ((size - 1) / 2).cast("int")
    roles = [F.struct(size.alias("len"), at.alias("pos"), F.lit(False).alias("longer"), *halves((size / 2).cast("int"), 0))]
    roles += [F.struct((size - 1).alias("len"), (at - d).alias("pos"), F.lit(True).alias("longer"), *halves(one, 1)) for d in (0, 1)]
    right = p.select(F.col("word").alias("b"), F.col("n").alias("nb"), "gram", F.explode(F.array(*roles)).alias("as")).select("b", "nb", "gram", "as.len", "as.pos", "as.longer", F.col("as.head").alias("bh"), F.col("as.tail").alias("bt"))
    met = left.join(right, ["gram", "len", "pos"]).filter((F.col("head") == F.col("bh")) | (F.col("tail") == F.col("bt")))
    met = met.filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer jumping; counts rise fivefold a link, so few rounds do."""
    m, i = scratch.write(links.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        up = m.select(F.col("word").alias("root"), F.col("root").alias("above"))
        nxt = scratch.write(m.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"roots{i + 1}")
        scratch.drop(f"roots{i}")
        i += 1
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        m = nxt.select("word", "root")


def variants(docs: DataFrame, *, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all texts, one row a word.

    Null and empty texts have no words; a null id is the empty string to the rule that drops letters; rows that repeat
    count as often as they are there. Texts and words of any length are read whole. Of near words with equal counts the
    smallest in code-point order is the form. An empty table gives no rows; columns of other names are not read.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(vocabulary(docs, every=every, least_length=least_length, least_count=least_count, id_col=id_col, text_col=text_col), "words", rows=500)
    pairs = scratch.write(near_pairs(words, scratch), "pairs")
    scratch.drop("prefixes")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    per = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    per = scratch.write(per, "per")
    roots = _roots(per.filter(F.col("form").isNotNull()), scratch)
    return per.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# Words one edit apart share what is left of them without one letter: at the same place if both lose one.
OP13_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT k, w, count(*) AS n FROM runs GROUP BY k, w),
hashed AS (SELECT w, n, CAST({crc_sql("k || ':' || w")} AS BIGINT) AS h FROM each, crc),
lost AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT best.word, min(near.near) AS form, max(near.m) AS form_n FROM best JOIN words ON words.word = best.word JOIN near ON near.word = best.word AND near.m = best.m WHERE best.m >= 5 * words.n GROUP BY best.word),
up AS (SELECT word, form AS root, 1 AS d FROM forms UNION ALL SELECT up.word, forms.form, d + 1 FROM up JOIN forms ON forms.word = up.root)
SELECT words.word, forms.form, coalesce(r.root, words.word) AS root, words.n, coalesce(best.n_near, 0) AS n_near, forms.form_n
FROM words LEFT JOIN best ON best.word = words.word LEFT JOIN forms ON forms.word = words.word LEFT JOIN (SELECT word, arg_max(root, d) AS root FROM up GROUP BY word) r ON r.word = words.word
"""
