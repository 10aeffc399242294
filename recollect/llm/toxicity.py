"""Toxicity by a factorization machine over hashed terms (operator 12).

A text's terms are its words and their beginnings, each once more if it occurs twice and three times, and its length
by powers of two. Each pair of terms weighs as the product of their factors says, so that an insult beside a mention of
a group can mean more than both do alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_key

#: Labelled documents that are learnt from, of each class at most, by the hash of their ids.
DOCS_PER_CLASS = 5_000
#: Values of the hash of a term, and the terms of the machine: those whose documents differ most by class.
HASHED, TERMS = 1 << 22, 4096
#: How sure that difference must be, in standard deviations.
STRONG = 2.5
#: Beginnings of longer words that are terms of their own, in characters.
HEADS = (3, 4, 5, 6, 7)
FACTORS, EPOCHS, RATE, DECAY = 8, 30, 0.1, (1e-4, 1e-3)
FLAGGED = 0.7
#: Words whose terms a worker remembers.
CACHE = 1 << 19

_WORD = re.compile(r"[^\W\d_]+")
_SIZES = 24


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


_HEAD = zlib.crc32(b"^")
#: Places of a term that occurs twice, and three times, from that of one that occurs once.
_AGAIN = 0x9E3779


def _hashes(word: str) -> list[int]:
    """The hashed terms of a word: itself and its beginnings."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED]
    h, at = _HEAD, 0
    for k in HEADS:
        if len(word) <= k:
            break
        h, at = zlib.crc32(word[at:k].encode("utf-8", "surrogatepass"), h), k
        out.append(h % HASHED)
    return out


def _times(h: int) -> tuple[int, int, int]:
    """The hashed terms of one, two and three occurrences."""
    return h, (h + _AGAIN) % HASHED, (h + 2 * _AGAIN) % HASHED


def _words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """Chosen terms by hash, and the bias, weights and factors; the last `_SIZES` rows are the lengths'."""

    place: dict[int, int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.bases = {(t - i * _AGAIN) % HASHED for t in self.place for i in range(3)}

    def rows(self, text: str | None) -> list[int]:
        words, seen, place, known = _words(text), Counter(), self.place, self.known
        if len(known) > CACHE:
            known.clear()
        for w, n in words.items():
            hs = known.get(w)
            if hs is None:
                hs = known[w] = tuple(self.bases.intersection(_hashes(w)))
            for h in hs:
                seen[h] += n
        found = {place[t] for h, n in seen.items() for t in _times(h)[: min(n, 3)] if t in place}
        return [*sorted(found), len(place) + min(_SIZES - 1, words.total().bit_length())]

    def sums(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The log-odds of each text, the texts and terms of its entries, and its sum of factors."""
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        ix = np.fromiter((i for r in rows for i in r), np.int64, len(at))
        v = self.factor[ix]
        first = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]].astype(np.int64)
        s = np.add.reduceat(v, first, axis=0)  # no text is without a row
        z = self.bias + np.add.reduceat(self.weight[ix], first) + ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), first)) / 2
        return z, at, ix, s

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums([self.rows(t) for t in texts])[0], -30, 30))) if texts else np.zeros(0)


def fit(machine: Machine, rows: list[list[int]], label: np.ndarray, share: np.ndarray, epochs: int = EPOCHS) -> None:
    """Learns by AdaGrad on the logistic loss; `share` weighs each row, so that the classes have their true shares."""
    r = np.random.default_rng(7)
    w, v = machine.weight, machine.factor
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = r.permutation(len(rows))
        for lo in range(0, len(order), 256):
            b = order[lo : lo + 256]
            z, at, ix, s = machine.sums([rows[i] for i in b])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[b]) * share[b] / len(b)
            u, inv = np.unique(ix, return_inverse=True)
            dw = np.bincount(inv, d[at], len(u)) + DECAY[0] * w[u]
            dv = np.zeros((len(u), v.shape[1]))
            np.add.at(dv, inv, d[at, None] * (s[at] - v[ix]))
            dv += DECAY[1] * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * dv / np.sqrt(gv[u])
            gb += d.sum() ** 2
            machine.bias -= RATE * d.sum() / np.sqrt(gb)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: tuple[Counter[int], Counter[int]] = (Counter(), Counter())
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            seen: Counter[int] = Counter()
            for w, times in _words(text.as_py()).items():
                for h in _hashes(w):
                    seen[h] += times
            n[toxic].update({t for h, times in seen.items() for t in _times(h)[: min(times, 3)]})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(n[toxic].keys()), pa.int64()), pa.array([toxic] * len(n[toxic]), pa.int32()), pa.array(list(n[toxic].values()), pa.int64())], ["term", "toxic", "n"])


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = DOCS_PER_CLASS) -> Machine:
    """A machine fitted to at most `limit` labelled documents of each class, none of them held out.

    An id with several labels counts as toxic if one says so; of several texts of an id the one of the smallest hash is
    read. Terms are chosen by Spark from the sample's counts by class; the driver holds the chosen terms of each of
    its documents.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    one, other = (known.filter(F.col("toxic") == t).orderBy(F.xxhash64("_id"), "_id").limit(limit) for t in (0, 1))
    chosen = scratch.write(one.unionByName(other), "chosen")
    texts = docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).select("_id", "toxic", F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("th"))
    texts = scratch.write(texts, "texts")
    own = texts.groupBy("_id").agg(F.min("th").alias("th"))
    texts = scratch.write(texts.join(F.broadcast(own), ["_id", "th"], "left_semi").dropDuplicates(["_id"]).select("toxic", "text"), "sample")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    n = texts.mapInArrow(_document_counts, "term long, toxic int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (a + 1)) - F.log((F.col("b") + 0.5) / (b + 1))
    strong = F.abs(odds) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = n.filter("a + b >= 3").select("term", strong.alias("z")).filter(F.col("z") >= STRONG).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    place = {r["term"]: i for i, r in enumerate(best)}
    machine = Machine(place, float(np.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5))), np.zeros(len(place) + _SIZES), np.random.default_rng(7).normal(0, 0.05, (len(place) + _SIZES, FACTORS)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [machine.rows(t.as_py()) for t in x.column(1)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "rows"])

    if not a or not b:
        machine.factor[:] = 0
        return machine  # nothing to tell apart: every text has the share of the labels
    got = sorted((r["toxic"], list(r["rows"])) for r in texts.mapInArrow(pick, "toxic int, rows array<int>").collect())
    label = np.array([t for t, _ in got], float)
    every = sum(total.values()) / (a + b)
    share = np.where(label == 1, total[1] / (a * every), total[0] / (b * every))
    fit(machine, [r for _, r in got], label, share)
    machine.known.clear()
    return machine


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    Null and empty texts have no term but their length and are scored like others; a null id is not held out and has no
    label. Rows that repeat an id are scored each by its text. Without labels of both classes all scores are the
    labels' share (0.5 without any). An empty table gives no rows; columns of other names are not read.
    """
    machine = learn(docs.select(F.col(id_col), F.col(text_col)), labels, Scratch(docs.sparkSession), id_col=id_col, text_col=text_col, label_col=label_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([np.zeros(0), *(machine.score([t.as_py()]) for t in b.column(2))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= FLAGGED).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Scratch(spark).write(toxicity(docs, table(spark, sf_dir, "labels")), "toxicity")
