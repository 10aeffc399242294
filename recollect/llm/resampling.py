"""Importance resampling towards a target text (operator 11): hashed n-gram gains, Gumbel scores, runs merged by tournaments.

A document's weight is the sum of its features' gains, read from one array by bucket. Its score adds Gumbel noise made
from its id, so the highest scores are a draw without replacement in proportion to the weights' exponentials. Documents
that can be drawn are sorted into a run per partition; runs are cut at shared score bounds, and each cut range is
merged from all runs by a tournament tree that stops at the exact number of draws and gives every drawn row its rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Buckets of features, longest feature in words, draws as a share of the documents of so many words, seed of the noise.
BUCKETS, GRAM, SHARE, LEAST_WORDS, SEED = 10_000, 3, (5, 100), 20, 42
#: Bytes of text that are split at once; a block ends at a separator, so a longer word makes it longer.
BLOCK = 1 << 20
#: Candidates of one range of scores, which one task merges.
RANGE_ROWS = 100_000

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_WORD = ((_LOWER >= 97) & (_LOWER <= 122)) | ((_LOWER >= 48) & (_LOWER <= 57)) | (_LOWER >= 128)


class Crc:
    """CRC-32 of many byte strings at once, and of their concatenations from their parts' sums and lengths."""

    #: Longer words are summed one by one.
    LONG = 48

    def __init__(self) -> None:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
        self.table = t
        basis = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        # levels[l][d] maps a sum to the sum with d * 64**l zero bytes after it, a table per byte of the sum.
        self.levels = []
        step = np.stack([t[v & 255] ^ (v >> 8) for v in basis])
        for _ in range(5):
            level = [basis]
            for _ in range(64):
                level.append(self._apply(level[-1], step))
            self.levels.append(np.stack(level[:64]))
            step = level[64]

    @staticmethod
    def _apply(v: np.ndarray, maps: np.ndarray) -> np.ndarray:
        return maps[0][v & 255] ^ maps[1][(v >> 8) & 255] ^ maps[2][(v >> 16) & 255] ^ maps[3][v >> 24]

    def byte(self, crc: np.ndarray, value: int) -> np.ndarray:
        """The sums with one more byte."""
        state = ~crc
        return ~(self.table[(state ^ np.uint32(value)) & 255] ^ (state >> 8))

    def joined(self, crc: np.ndarray, then: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The sums of strings whose second part has the sum `then` and `length` bytes."""
        for maps in self.levels:
            d = length & 63
            crc = maps[d, 0, crc & 255] ^ maps[d, 1, (crc >> 8) & 255] ^ maps[d, 2, (crc >> 16) & 255] ^ maps[d, 3, crc >> 24]
            length = length >> 6
            if not length.any():
                break
        return crc ^ then

    def words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        s, n = start[order], length[order]
        c = np.full(len(s), 0xFFFFFFFF, np.uint32)
        for j in range(int(min(self.LONG, n[0])) if len(n) else 0):
            k = int(np.searchsorted(-n, -j, "left"))
            c[:k] = self.table[(c[:k] ^ data[s[:k] + j]) & 255] ^ (c[:k] >> 8)
        c = ~c
        for i in range(int(np.searchsorted(-n, -self.LONG, "left"))):
            c[i] = zlib.crc32(data[s[i] : s[i] + n[i]])
        out = np.empty_like(c)
        out[order] = c
        return out


_crc: list[Crc] = []


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks (from, to) of the bytes of a batch that cut no word."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        to = min(end, at + BLOCK)
        while to < end and _WORD[data[to]]:
            gap = np.flatnonzero(~_WORD[data[to : to + 4096]])
            edge = int(bounds[np.searchsorted(bounds, to, "left")])  # where a text ends, a word does
            nxt = to + int(gap[0]) if len(gap) else to + 4096
            to = min(nxt, edge, end)
            if len(gap) or to == edge:
                break
        yield at, to
        at = to


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, CRC-32 of each feature) by blocks of a batch's texts.

    A feature is a run of 1 to 3 words of one text, joined by a space; it comes in the block of its last word, so two
    words and their sums are carried from one block to the next.
    """
    if not _crc:
        _crc.append(Crc())
    crc_of = _crc[0]
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    rows, sums, sizes = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for at, to in _pieces(data, bounds):
        part = _LOWER[data[at:to]]
        word = _WORD[part]
        cut = np.zeros(len(part) + 1, bool)  # a text starts here
        cut[bounds[(bounds >= at) & (bounds <= to)] - at] = True
        cut[[0, -1]] = True
        start = np.flatnonzero(word & (cut[:-1] | ~np.r_[False, word[:-1]]))
        end = np.flatnonzero(word & (cut[1:] | ~np.r_[word[1:], False])) + 1
        old = len(rows)
        rows = np.r_[rows, np.searchsorted(bounds, at + start, "right") - 1]
        sums, sizes = np.r_[sums, crc_of.words(part, start, end - start)], np.r_[sizes, end - start]
        row, crc = [rows[old:]], [sums[old:]]
        gram = sums
        for n in range(1, GRAM):  # gram[i] ends at word i + n - 1
            gram = crc_of.joined(crc_of.byte(gram[:-1], 0x20), sums[n:], sizes[n:])
            fresh = np.arange(len(gram)) + n >= old
            own = fresh & (rows[n:] == rows[:-n]) if len(gram) else fresh
            row.append(rows[n:][own])
            crc.append(gram[own])
        yield rows[old:], np.concatenate(row), np.concatenate(crc)
        rows, sums, sizes = rows[-(GRAM - 1) :], sums[-(GRAM - 1) :], sizes[-(GRAM - 1) :]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sums its own, `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, crc in features(b.column(0)):
                n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the logarithm of its smoothed share of the target over that of the source, rounded down."""
    a, b = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(t + 1) * a) / (float(s + 1) * b))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and n_words, n_features and weight of every row."""
    src = docs.select(*keep, F.col(text_col))  # read by place, so no name can clash
    out = docs.select(*keep).withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")})
    gain = gain.astype(float)  # sums of whole numbers, exact below 2**53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f, w = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for word, row, crc in features(b.column(len(keep))):
                n += np.bincount(word, minlength=b.num_rows)
                f += np.bincount(row, minlength=b.num_rows)
                w += np.bincount(row, gain[crc % np.uint32(len(gain))], b.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *map(pa.array, (n, f, w))], [*keep, "n_words", "n_features", "weight"])

    return src.mapInArrow(run, out.schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw that the id fixes, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: After every other key.
_END = (math.inf,)


def tournament(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order: each that leaves is replaced from its run and plays one match a level of a loser tree."""
    k = len(runs)
    sources = [iter(r) for r in runs]
    head = [next(s, _END) for s in sources]
    winner, loser = [0] * k + list(range(k)), [0] * k
    for i in range(k - 1, 0, -1):
        a, b = winner[2 * i], winner[2 * i + 1]
        winner[i], loser[i] = (a, b) if head[a] <= head[b] else (b, a)
    top = winner[1]
    while head[top] is not _END:
        yield head[top]
        head[top] = next(sources[top], _END)
        i = (top + k) // 2
        while i:
            if head[loser[i]] < head[top]:
                loser[i], top = top, loser[i]
            i //= 2


COLUMNS = ("doc_id", "n_features", "weight", "score")


def draw(scored: DataFrame, share: tuple[int, int] = SHARE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`scored` (doc_id, n_features, weight, score, eligible) with `rank`: 1, 2, .. of the drawn rows, null of the others.

    Of the n eligible rows the floor(n * share) of the highest scores are drawn, ties to the smaller id (null last).
    Rows below a score that enough rows reach are left where they are. The others are counted by equal rows, sorted
    into a run per partition and cut at score bounds that all runs share, so that ranks go on from range to range.
    """
    scratch = Scratch(scored.sparkSession)
    top = F.percentile_approx("score", F.lit(max(0.0, 1 - share[0] / share[1] - 0.01)), F.lit(1000))
    n, low = scored.filter("eligible").agg(F.count(F.lit(1)), top).first()
    draws = n * share[0] // share[1]
    rest = [*COLUMNS, F.lit(None).cast("long").alias("rank")]
    if not draws:
        return scored.select(rest)
    enough = F.col("eligible") & (F.col("score") >= F.lit(low))
    if scored.filter(enough).count() < draws:  # beyond what the percentile promises
        enough = F.col("eligible")
    pool = scratch.write(scored.filter(enough).groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("copies")), "pool")
    parts = -(-pool.count() // range_rows)
    bounds = []
    if parts > 1:
        bounds = sorted(set(pool.agg(F.percentile_approx("score", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts))).first()[0]))
    cuts = -np.array(bounds[::-1], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            ranges = np.searchsorted(cuts, -b.column("score").to_numpy(), "right") if len(cuts) else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranges.astype(np.int32)), pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "range", "at"])
            at += b.num_rows

    run = pool.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features").withColumn("run", F.spark_partition_id())
    runs = scratch.write(run.mapInArrow(cut, run.withColumns({"range": F.lit(0), "at": F.lit(0).cast("long")}).schema), "runs", rows=10_000)
    before, last, total = {}, -1, 0
    for r in sorted(runs.groupBy("range").agg(F.sum("copies").alias("n")).collect()):
        if total < draws:
            before[r["range"]], last = total, r["range"]
        total += r["n"]

    def merge(t: pa.Table) -> pa.Table:
        lists = {}
        for x in zip(t["run"].to_pylist(), t["at"].to_pylist(), *[t[c].to_pylist() for c in (*COLUMNS, "copies")], strict=True):
            lists.setdefault(x[0], []).append(x)
        slices = []
        for own in lists.values():
            own.sort(key=lambda x: x[1])  # as the run has them
            slices.append([(-score, doc_id is None, doc_id or 0, f, weight, copies, doc_id) for _, _, doc_id, f, weight, score, copies in own])
        out, left = [], draws - before[t["range"][0].as_py()]
        for s, _, _, f, w, copies, doc_id in tournament(slices):
            drawn = max(0, min(copies, left))
            out.append((doc_id, f, w, -s, copies, drawn, draws - left if drawn else None))
            left -= drawn
        names = (*COLUMNS, "copies", "drawn", "first")
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out, strict=True), strict=True)})

    merged = runs.filter(F.col("range") <= last).groupBy("range").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, copies long, drawn long, first long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("i")
    ranked = scratch.write(merged, "merged").select(*COLUMNS, "drawn", "first", each).select(*COLUMNS, F.when(F.col("i") <= F.col("drawn"), F.col("first") + F.col("i")).alias("rank"))
    later = runs.filter(F.col("range") > last).select(*COLUMNS, each).select(rest)
    return scored.filter(~enough).select(rest).unionByName(ranked).unionByName(later)


def resample(docs: DataFrame, target: DataFrame, *, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row, drawn towards the text of `target` (its column `text`).

    Null and empty texts have no word: weight 0, never drawn. A null id is the empty string to the noise and comes after
    all others among ties; rows that repeat an id each stand for themselves, and of equal rows as many are drawn as the
    number of draws asks for. Texts of any length are read whole, in blocks. An empty table gives no rows; an empty
    target gains from smoothing alone. Columns of other names are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(rows, buckets=buckets), bucket_counts(target, buckets=buckets))
    w = weighed(rows, gain, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    return draw(Scratch(docs.sparkSession).write(w, "scored"), share)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The CRC's table comes from its rule: eight shifts by the reversed polynomial 0xEDB88320.
CRC_SQL = """crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, beside the expression `crc`."""
    h = f"hex(encode({text}))"
    return f"""xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT))),
      lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) + 1 AS BIGINT)])), 4294967295)"""


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_GRAMS = """SELECT {r}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM {src}"""
OP11_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dg AS (SELECT r, g, count(*) AS n FROM ({_GRAMS.format(r='r', src='d')}) GROUP BY r, g), bg AS (SELECT g, count(*) AS n FROM ({_GRAMS.format(r='1 AS r', src='b')}) GROUP BY g),
hashed AS (SELECT g, CAST({crc_sql('g')} % 10000 AS BIGINT) AS k FROM (SELECT g FROM dg UNION SELECT g FROM bg), crc),
src AS (SELECT k, sum(n) AS s FROM dg JOIN hashed USING (g) GROUP BY k), tgt AS (SELECT k, sum(n) AS t FROM bg JOIN hashed USING (g) GROUP BY k),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM src) AS ss, (SELECT coalesce(sum(t), 0) FROM tgt) AS tt),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM src LEFT JOIN tgt USING (k), tot),
per AS (SELECT r, sum(n * gain) AS weight FROM dg JOIN hashed USING (g) JOIN gain USING (k) GROUP BY r),
sc AS (SELECT doc_id, len(w) >= 20 AS ok, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN per USING (r)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id NULLS LAST, n_features) AS i FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND i <= (SELECT count(*) * 5 // 100 FROM sc WHERE ok) THEN i END AS rank FROM rk
"""
