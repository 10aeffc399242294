"""Near copies by shingle similarity: MinHash bands propose pairs, whole shingle sets decide (a step of the pipeline)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed
from .simhash import FOLD

#: Words of a shingle, and the Jaccard similarity of shingle sets from which two texts are copies.
WIDTH, SIMILARITY = 5, 0.8
#: Two sets at 0.8 share none of BANDS bands of DEPTH minima with probability (1 - 0.8 ** 6) ** 48 < 1e-6; less if closer.
BANDS, DEPTH = 48, 6
#: Pairs of which fewer minima agree are not compared further: at 0.8 that is six deviations off, under 1e-9.
AGREE = 0.66
#: Rounds in which documents that surely stay drop what is near them, before all that is left of a bucket is compared.
ROUNDS = 3
#: Shingles whose minima are taken at once (a cache's worth), and pairs whose texts travel in one Arrow batch; both bound memory.
CHUNK, PAIR_ROWS = 512, 100
#: Rows of one bucket that a task compares with each other; a larger one is dealt into parts, each pair of parts to a task.
PART = 2048
#: Bytes of texts whose shingles a task keeps while it compares pairs.
KEPT_BYTES = 4 << 20
_rng = np.random.default_rng(5)
FACTORS = _rng.integers(0, 1 << 31, BANDS * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _rng.integers(0, 1 << 32, BANDS * DEPTH, np.uint32)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, A-Z in lower case; a text of fewer words is one shingle."""
    words = (text or b"").translate(FOLD).split()
    grams = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g)) for g in grams), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def minima(s: np.ndarray) -> np.ndarray:
    """The least values of a set of shingles under BANDS * DEPTH hash functions."""
    x = s.astype(np.uint32)  # the minima are over 32 bits of each shingle's hash; the sets that decide have all 64
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for c in range(0, len(x), CHUNK):
        h = FACTORS[:, None] * x[None, c : c + CHUNK]
        h += TERMS[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> list[int]:
    """A hash of each band of minima."""
    return [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, DEPTH))]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, sig = [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            low = minima(s)
            h.append(np.array(bands(low) if len(s) else [], np.uint64).view(np.int64))
            sig.append((low & 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("th"), pa.array(h, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["dk", "th", "h", "sig"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE)) if b.num_rows else b.select(["a", "b"])


def _alike(t: pa.Table) -> pa.Table:
    """Of the rows of two parts of a bucket, or of one, the pairs (k before k2) of which at least AGREE of the minima agree."""
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    dk, th, own = (t[c].to_numpy() for c in ("dk", "th", "own"))
    y = np.flatnonzero(own == j)
    found = []
    for x in np.flatnonzero(own == i):
        later = y[y > x] if i == j else y
        found += [(x, z) for z in later[(sig[later] == sig[x]).mean(axis=1) >= AGREE]]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    swap = (dk[a] > dk[b]) | ((dk[a] == dk[b]) & (th[a] > th[b]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table({"da": dk[a], "a": th[a], "db": dk[b], "b": th[b]})


def _bucket_pairs(left: DataFrame, found: DataFrame) -> DataFrame:
    """(k, k2), k < k2, of the rows of one bucket or another whose minima agree. All pairs of a bucket are compared, in the
    tasks that hold its rows, and only those that agree become rows."""
    n = left.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART // 2)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    sigs = found.select(F.struct("dk", "th").alias("k"), "sig")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("own", p).alias("i"), F.greatest("own", p).alias("j"))))
    rows = left.join(n, "h").join(sigs, "k").withColumn("own", own).select("h", "k.dk", "k.th", "sig", "own", cells.alias("c"))
    rows = rows.select("h", "dk", "th", "sig", "own", "c.i", "c.j")
    out = rows.groupBy("h", "i", "j").applyInArrow(_alike, "da long, a long, db long, b long").distinct()
    return out.select(F.struct(F.col("da").alias("dk"), F.col("a").alias("th")).alias("k"), F.struct(F.col("db").alias("dk"), F.col("b").alias("th")).alias("k2"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[bytes, np.ndarray] = {}
    size = 0

    def sets(text: bytes | None) -> np.ndarray:
        nonlocal size
        text = text or b""
        if text not in kept:
            if size > KEPT_BYTES:
                kept.clear()
                size = 0
            kept[text] = shingles(text)
            size += len(text)
        return kept[text]

    for b in batches:
        keep = [similarity(sets(x.as_py()), sets(y.as_py())) >= SIMILARITY for x, y in zip(b.column("ta"), b.column("tb"), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(rows: DataFrame, found: DataFrame, pairs: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """Of pairs (a, b: text keys) those that are similar. Minima, a byte each, reject most others before texts are read."""
    a, b = found.select(F.col("th").alias("a"), F.col("sig").alias("sa")), found.select(F.col("th").alias("b"), F.col("sig").alias("sb"))
    pairs = scratch.write(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"), f"{step}_agree", rows=10_000)
    both = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    texts = scratch.write(rows.select("th", "text").join(both, "th", "left_semi").dropDuplicates(["th"]), f"{step}_texts")
    a, b = texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), texts.select(F.col("th").alias("b"), F.col("text").alias("tb"))
    out = scratch.write(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_similar, "a long, b long"), f"{step}_edges", rows=PAIR_ROWS)
    scratch.drop(f"{step}_texts", f"{step}_agree")
    return out


def _losers(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(th) of the nodes that go if, in order of their keys, each goes that is linked to a smaller one that stays.

    edges are (a, ka, b, kb) with ka < kb, all links of the nodes. Each round a node without a smaller neighbour left
    stays and its neighbours go.
    """
    gone, i = edges.select(F.col("b").alias("th")).limit(0), 0
    while not edges.isEmpty():
        firm = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        lost = scratch.write(edges.join(firm, "a").select(F.col("b").alias("th")).distinct(), f"lost{i}")
        gone = gone.unionByName(lost)
        alive = edges.join(firm, "a", "left_anti").join(lost.withColumnRenamed("th", "a"), "a", "left_anti").join(lost.withColumnRenamed("th", "b"), "b", "left_anti")
        edges = scratch.write(alive.select("a", "ka", "b", "kb"), f"alive{i}")
        i += 1
    return gone


def without_near_copies(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Those of `kept` (dk, th as in `keyed`, each text once) that stay: in order of (dk, th), each goes that is similar to
    a smaller one that stays, so no two that stay are similar and none goes without such a one.

    A document that is the smallest in all of its bands' buckets stays, whatever the others do. In a few rounds such
    documents drop what is similar to them, which settles large groups by a pair a member; what is then left of a bucket
    is compared with each other. The whole shingle sets of two texts decide. Null, empty and wordless texts are in no
    bucket and stay; rows that repeat a key count once; null ids (the largest dk) come last.
    """
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs).select("dk", "th", F.col("text").cast("binary").alias("text"))
    found = scratch.write(rows.mapInArrow(_bands, "dk long, th long, h array<long>, sig binary"), "bands")
    found = scratch.write(found.join(kept, ["dk", "th"], "left_semi").dropDuplicates(["dk", "th"]), "kept")
    scratch.drop("bands")
    flat = found.select(F.struct("dk", "th").alias("k"), F.explode("h").alias("h"))
    shared = flat.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first <> last").select("h")
    left = scratch.write(flat.join(shared, "h", "left_semi"), "left0")
    lost = []
    for i in range(ROUNDS):
        lead = left.groupBy("h").agg(F.min("k").alias("first"))
        met = scratch.write(left.join(lead, "h"), f"met{i}")
        firm = scratch.write(met.groupBy("k").agg(F.min(F.col("first") == F.col("k")).alias("firm")).filter("firm").select(F.col("k").alias("first")), f"firm{i}")
        pairs = met.filter("k <> first").select("first", "k").distinct().join(firm, "first").select(F.col("first.th").alias("a"), F.col("k.th").alias("b"))
        edges = _verified(rows, found, pairs, scratch, f"round{i}")
        lost.append(scratch.write(edges.select(F.col("b").alias("th")).distinct(), f"lost_{i}"))
        rest = left.join(firm.withColumnRenamed("first", "k"), "k", "left_anti").withColumn("th", F.col("k.th")).join(lost[-1], "th", "left_anti").select("k", "h")
        busy = rest.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        left = scratch.write(rest.join(busy, "h", "left_semi"), f"left{i + 1}")
        scratch.drop(f"met{i}", f"left{i}")
        if left.isEmpty():
            break
    pairs = scratch.write(_bucket_pairs(left, found), "pairs")
    edges = _verified(rows, found, pairs.select(F.col("k.th").alias("a"), F.col("k2.th").alias("b")), scratch, "rest")
    named = edges.join(pairs.select(F.col("k.th").alias("a"), F.col("k").alias("ka"), F.col("k2.th").alias("b"), F.col("k2").alias("kb")), ["a", "b"])
    lost.append(_losers(scratch.write(named, "links"), scratch))
    gone = lost[0]
    for x in lost[1:]:
        gone = gone.unionByName(x)
    return found.select("dk", "th").join(gone.distinct(), "th", "left_anti")
