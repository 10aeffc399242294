"""Substring deduplication by seed and extend (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table
from .repeats import CHECK_TWICE, M1, M2, ROWS, WHOLE, candidates, covered, mix, packed, powers, runs, spans_of, word_tokens

#: Words of a window, and of a seed: any two equal windows share a winnowed seed.
WINDOW, SEED_WORDS = 35, 8


def _window_hashes(x: np.ndarray, lo: int, n: int, win: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the n windows from lo on; together they stand for the words."""
    part, i = x[lo : lo + n - 1 + win], np.arange(n)
    out = []
    for m in (M1, M2):
        p = np.r_[np.zeros(1, np.uint64), np.cumsum(part * powers(m)[0][: len(part)], dtype=np.uint64)]
        out.append(mix((p[i + win] - p[i]) * powers(m)[1][i]).view(np.int64))
    return out[0], out[1]


def remove_repeats(docs: DataFrame, *, win: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (maximal removed runs of words: at, len) and the kept text.

    A word goes if a window over it starts anywhere else too; windows are judged on the input. Words are runs of bytes
    other than white space, unchanged; a null or empty text has none, and texts under `win` words lose none. Rows that
    repeat a text (with the same id or another) are repeats of each other and lose every word that a window covers.
    Null ids are kept as they are; long texts are read whole, in chunks; an empty table gives no rows. Columns of other
    names are not read. Words are compared by hashes: a whole span by 64 bits beside the 64 of its seed, a window by
    two of 64 bits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for dk, th, text, (lo, n, kind) in zip(*(b.column(i).to_pylist() for i in range(3)), runs(b.column(3)), strict=True):
                x = word_tokens(text)
                for i, m, k in zip(lo.tolist(), n.tolist(), kind.tolist(), strict=True):
                    h1, h2 = _window_hashes(x, i, m, win)
                    out.append((h1, h2, np.full(m, dk), np.full(m, th), np.arange(i, i + m, dtype=np.int32), np.full(m, 2 if k == CHECK_TWICE else 1, np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["h1", "h2", "dk", "th", "lo", "weight"])

    known = candidates(d, scratch, tokens=word_tokens, win=win, k=SEED_WORDS, earlier=False)
    checks = known.filter(F.col("kind") != WHOLE).groupBy("dk", "th").agg(F.collect_set(packed(kind="kind")).alias("checks"))
    checked = d.join(checks, ["dk", "th"]).select("dk", "th", "text", "checks")
    w = scratch.write(checked.mapInArrow(explode, "h1 long, h2 long, dk long, th long, lo int, weight int"), "windows", rows=ROWS)
    again = w.groupBy("h1", "h2").agg(F.sum("weight").alias("s")).filter("s > 1").select("h1", "h2")
    found = w.filter("weight = 1").join(again, ["h1", "h2"]).select("dk", "th", "lo", F.lit(1).alias("n"))
    whole = known.filter(F.col("kind") == WHOLE).select("dk", "th", "lo", "n")
    spans = whole.unionByName(found).groupBy("dk", "th").agg(F.collect_set(packed()).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<at:int,len:int>>" + (", text string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone_, kept_, edges = [], [], [], []
            for text, (lo, m, _) in zip(b.column(1).to_pylist(), runs(b.column(2)), strict=True):
                words = (text or b"").split()
                gone = covered(lo, m, len(words), win)
                n.append(len(words))
                gone_.append(int(gone.sum()))
                edges.append(np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])))
                kept_.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone_[-1] else b" ".join(words))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept_], pa.string()), spans_of(edges)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([k.decode("utf-8", "replace") for k in kept_], pa.string())] if with_text else cols, [*names, "text"] if with_text else names)

    out = d.join(spans, ["dk", "th"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    done = scratch.write(out, "result", rows=ROWS)
    scratch.drop("known", "windows")
    return done


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM win WHERE s IN (SELECT s FROM rep)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.q) AS s FROM words LEFT JOIN hit ON words.r = hit.r AND words.q = hit.q WHERE hit.r IS NULL GROUP BY words.r),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.r = gone.r LEFT JOIN kept ON d.r = kept.r
"""
