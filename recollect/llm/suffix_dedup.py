"""Suffix-array deduplication by longest previous factors (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table
from .repeats import ROWS, WHOLE, byte_tokens, candidates, covered, packed, runs, spans_of

#: Bytes of a string that counts as repeated, and of a seed: any two equal strings share a winnowed seed.
LENGTH, SEED_BYTES = 50, 20
#: Suffixes that a task sorts at once, before and after they are dealt to ranges.
SORTED = 300_000
#: Bytes of cut suffixes that a range is to hold, and the most ranges there are (beyond, ranges grow and are settled in steps).
RANGE_BYTES, MAX_RANGES = 24 << 20, 20_000
#: Documents that range borders are sampled from at least, and sampled suffixes for each range.
SAMPLE_DOCS, SAMPLE_A_RANGE = 2000, 40


def common_prefixes(rows: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How many bytes each row of a byte matrix, cut to `need` bytes, has in common with the row before (the first: 0)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        apart = rows[1:] != rows[:-1]
        out[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(need[1:], need[:-1]))
    return out


def nearest_smaller(lcp: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the nearest one before it with a smaller key (-1: none), and the least of `lcp` on the way.

    Nothing is looked for beyond a step of less than `length` in common. All places jump at once: whatever lies between
    a place and the one that it points to has no smaller key, so a pointer may follow its target's pointer.
    """
    to, least = np.arange(len(key)) - 1, lcp.copy()
    stop = least < length
    to[stop] = -1
    open_ = np.flatnonzero(~stop)
    while len(open_):
        open_ = open_[key[to[open_]] >= key[open_]]
        at = to[open_]
        least[open_], to[open_] = np.minimum(least[open_], least[at]), to[at]
        stop = (to[open_] < 0) | (least[open_] < length)
        to[open_[stop]] = -1
        open_ = open_[~stop]
    least[to < 0] = 0
    return to, least


def previous_factors(rows: np.ndarray, need: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each suffix: the most bytes that it has in common with one of a smaller key.

    Suffixes (a byte matrix, each cut to `need` bytes) are in suffix order. In that order the longest such match is
    with the previous or the next smaller position (PSV, NSV): the nearest suffix on either side whose key is smaller.
    Factors under `length` bytes are 0.
    """
    lcp = common_prefixes(rows, need)
    before = nearest_smaller(lcp, key, length)[1]
    after = nearest_smaller(np.r_[0, lcp[:0:-1]], key[::-1], length)[1][::-1]
    return np.maximum(before, after)


def _sorted(rows: np.ndarray, need: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes in suffix order (of equal ones the shorter cut first, then the smaller key) with their columns."""
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((cols[0], need, text))
    return tuple(x[order] for x in (rows, need, *cols))


def _first_key(rows: np.ndarray, need: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The smallest key among the suffixes that are equal to each, in sorted order."""
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1) | (need[1:] != need[:-1])]
    return key[new][np.cumsum(new) - 1]


def _suffixes(texts: list[bytes], marks: pa.Array, length: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, lo, n, need, rows): the suffixes that marks ask for, cut; those of a whole span stand for all its n windows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for d, (text, (lo, n, kind)) in enumerate(zip(texts, runs(marks), strict=True)):
        one = kind != WHOLE
        single = np.unique(np.repeat(lo[one] - np.r_[0, np.cumsum(n[one])[:-1]], n[one]) + np.arange(n[one].sum())) if one.any() else lo[:0]
        lo, n = np.r_[lo[~one], single], np.r_[n[~one], np.ones(len(single), np.int64)]
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(width), np.uint8), width)
        for c in range(0, len(lo), SORTED):
            at, m = lo[c : c + SORTED], n[c : c + SORTED]
            need, rows = m + (length - 1), windows[at]
            rows[np.arange(width) >= need[:, None]] = 0
            held.append((np.full(len(at), d), at, m, need, rows))
            size += len(at)
            if size >= SORTED:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _pack(rows: np.ndarray, need: np.ndarray, *cols: np.ndarray) -> bytes:
    """Suffixes without what lies behind their cut, compressed, with (key, th, lo, n)."""
    flat = rows[np.arange(rows.shape[1]) < need[:, None]]
    parts = [need.astype(np.uint16), *(c.astype(t) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.uint16), strict=True)), flat]
    raw = b"".join(x.tobytes() for x in parts)
    return np.array([len(need), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, ...]:
    m, size = np.frombuffer(blob, np.int64, 2)
    raw = pa.decompress(blob[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
    at, cols = 0, []
    for t in (np.uint16, np.int64, np.int64, np.int32, np.uint16):
        cols.append(np.frombuffer(raw, t, m, at).astype(np.int64))
        at += m * np.dtype(t).itemsize
    rows = np.zeros((m, width), np.uint8)
    rows[np.arange(width) < cols[0][:, None]] = np.frombuffer(raw, np.uint8, -1, at)
    return rows, *cols


def repeated_suffixes(marked: DataFrame, known: DataFrame, scratch: Scratch, *, length: int, width: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(dk, th, lo, n): the runs of windows among those marked that a document of smaller dk has too.

    marked has (dk, th, text, marks). The marked suffixes are sorted, dealt to ranges of the suffix order by sampled
    borders, and sorted there; where the longest previous factor reaches a suffix's cut, its windows are repeated.
    Equal suffixes are in one range, and whatever a marked suffix may match to its cut is equal to another marked one,
    so no match needs suffixes of two ranges. Before they travel, of equal suffixes of one batch only those of the
    smallest dk go on: a string that very many documents hold comes once a batch. In its range the same is done each
    time SORTED suffixes have come, so what is held there is bounded by the different strings of the range.
    """
    spark = marked.sparkSession
    work = known.agg(F.sum(F.when(F.col("kind") == WHOLE, F.col("n") + length).otherwise(F.col("n") * length)), F.sum(F.when(F.col("kind") == WHOLE, 1).otherwise(F.col("n"))), F.count(F.lit(1)))
    size, count, _ = work.first()
    cores = spark.sparkContext.defaultParallelism
    ranges = int(min(MAX_RANGES, max(1, -(-(size or 0) // range_bytes), min(2 * cores, (count or 0) // 5000))))
    docs = max(1, marked.count())
    share = min(1.0, max(SAMPLE_DOCS, 4 * ranges) / docs)
    step = max(1, int((count or 0) * share / (SAMPLE_A_RANGE * ranges)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, need, rows in _suffixes(b.column(0).to_pylist(), b.column(1), length, width):
                i = slice((len(need) // 2) % step, None, step)
                yield pa.RecordBatch.from_arrays([pa.array([r[:n].tobytes() for r, n in zip(rows[i], need[i], strict=True)], pa.binary())], ["s"])

    some = marked.filter(F.pmod(F.xxhash64("dk", "th", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if ranges > 1 else marked.limit(0)
    seen = sorted(r[0] for r in some.select("text", "marks").mapInArrow(sample, "s binary").collect()) if ranges > 1 else []
    borders = np.array([bytes(seen[len(seen) * i // ranges]) for i in range(1, ranges)] if seen else [], f"S{width}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, blobs, done = [], [], []
            dk, th = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for doc, lo, n, need, rows in _suffixes(b.column(2).to_pylist(), b.column(3), length, width):
                rows, need, key, t, lo, n = _sorted(rows, need, dk[doc], th[doc], lo, n)
                hit = previous_factors(rows, need, key, length) >= need
                if hit.any():
                    ids.append(int(t[0] % ranges))
                    blobs.append(None)
                    done.append(np.stack([x[hit] for x in (key, t, lo, n)]).tobytes())
                go = key == _first_key(rows, need, key)
                rows, need, key, t, lo, n = (x[go] for x in (rows, need, key, t, lo, n))
                cut = np.r_[0, np.searchsorted(rows.view(f"S{width}").ravel(), borders), len(rows)]
                for p in np.flatnonzero(np.diff(cut)):
                    i = slice(cut[p], cut[p + 1])
                    ids.append(p)
                    blobs.append(_pack(rows[i], need[i], key[i], t[i], lo[i], n[i]))
                    done.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.array(done, pa.binary())], ["range", "suffixes", "done"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes of one range: sorted, judged by their longest previous factors."""
        held: list[tuple[np.ndarray, ...]] = []
        size = kept = 0

        def found(*cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(cols, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["dk", "th", "lo", "n"])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, kept
            rows, need, key, t, lo, n = _sorted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            hit = previous_factors(rows, need, key, length) >= need
            yield from found(key[hit], t[hit], lo[hit], n[hit])
            go = key == _first_key(rows, need, key)
            held, size = [tuple(x[go] for x in (rows, need, key, t, lo, n))], int(go.sum())
            kept = size

        for b in batches:
            for blob, done in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if done is not None:
                    yield from found(*np.frombuffer(done, np.int64).reshape(4, -1))
                else:
                    held.append(_unpack(blob, width))
                    size += len(held[-1][0])
                    if size >= 2 * kept + SORTED:
                        yield from settle()
        if held:
            yield from settle()

    dealt = marked.select("dk", "th", "text", "marks").mapInArrow(deal, "range int, suffixes binary, done binary").repartitionById(ranges, "range")
    return scratch.write(dealt.mapInArrow(factors, "dk long, th long, lo int, n int"), "factors", rows=ROWS)


def remove_later_copies(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs of bytes: at, len) and the kept bytes.

    A byte goes if a string of `length` bytes over it also starts in a document of smaller id; strings are judged on
    the input, overlaps count, and matches do not cross documents, so the first copy stays whole. Null and empty texts
    have no bytes, long ones are read whole, an empty table gives no rows. Rows of equal id are one rank: neither is
    before the other, and a null id ranks last. Columns of other names are not read.

    Winnowed seeds that two documents share say which suffixes can match at all; all others are left out of the sort.
    What matches is decided by the suffixes' own bytes, by `repeated_suffixes`.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    known = candidates(d, scratch, tokens=byte_tokens, win=length, k=SEED_BYTES, earlier=True)
    marks = known.groupBy("dk", "th").agg(F.collect_set(packed(kind="kind")).alias("marks"))
    marked = scratch.write(d.join(marks, ["dk", "th"]).select("dk", "th", "text", "marks"), "marked", rows=ROWS)
    found = repeated_suffixes(marked, known, scratch, length=length, width=2 * length - SEED_BYTES)
    scratch.drop("known", "marked")
    spans = found.groupBy("dk", "th").agg(F.collect_set(packed()).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<at:int,len:int>>" + (", kept binary" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone_, kept_, edges = [], [], [], []
            for text, (lo, m, _) in zip(b.column(1).to_pylist(), runs(b.column(2)), strict=True):
                text = text or b""
                gone = covered(lo, m, len(text), length)
                n.append(len(text))
                gone_.append(int(gone.sum()))
                edges.append(np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])))
                kept_.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if gone_[-1] else text)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array([len(e) // 2 for e in edges], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept_], pa.string()), spans_of(edges)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept_, pa.binary())] if with_text else cols, [*names, "kept"] if with_text else names)

    out = d.join(spans, ["dk", "th"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    done = scratch.write(out, "result", rows=ROWS)
    scratch.drop("factors")
    return done


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_copies(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


OP10_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS dk, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT r, dk, unnest(list_transform(range(0, greatest(n - 49, 0)), lambda i: substr(h, 2 * i + 1, 100))) AS s, unnest(range(0, greatest(n - 49, 0))) AS i FROM n),
f AS (SELECT s, min(dk) AS m FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i FROM w JOIN f ON w.s = f.s WHERE dk > m),
cut AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
grp AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM cut),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY r, g),
gaps AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS c FROM runs),
agg AS (
  SELECT gaps.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d ON d.r = gaps.r GROUP BY gaps.r)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN agg ON n.r = agg.r
"""
