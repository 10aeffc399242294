"""Language identification by cross-parsing entropy over suffix automata (operator 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, Scratch, table

#: Labelled text per language that a model is built from: so many documents, by the hash of their ids, up to CHARS in all.
DOCS_PER_LANG, CHARS_PER_LANG = 200, 24_576
#: A text is parsed in pieces of so many characters, all of them, so that pieces of many texts advance together; each
#: piece goes on where the one before it ended, so the pieces show in no result.
PIECE = 256
#: Pieces that advance together; bounds memory for very long texts.
LANES = 1 << 14
#: Codes of a state's dense row: the commonest letters of all samples. The others' transitions are kept sparse.
DENSE = 64
UND = "und"


def letters(sample: str) -> np.ndarray:
    """Code points to codes: 1 is everything that is no letter, 2 a letter that no sample holds, 3.. the sample's letters, commonest first, in lower case."""
    common = [c for c, _ in sorted(Counter(x for x in sample.lower() if x.isalpha()).items(), key=lambda x: (-x[1], x[0]))]
    code = {c: i + 3 for i, c in enumerate(common)}
    lut = np.ones(0x110000, np.uint8 if len(code) < 253 else np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            lut[cp] = code.get(c.lower(), 2)
    return lut


class Table(NamedTuple):
    """Transitions: a dense row a state for codes below DENSE, 0 where there is none, and sorted (state, code) keys for the others."""

    dense: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def step(self, state: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        rare = np.flatnonzero(code >= DENSE)
        if not len(rare):
            return self.dense[state * DENSE + code]
        to = self.dense[state * DENSE + np.where(code < DENSE, code, 0)]
        if len(self.keys):  # else a rare code has no transition
            key = (np.broadcast_to(state, code.shape)[rare].astype(np.int64) << 32) | code[rare].astype(np.int64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[at] == key, self.values[at], 0)
        return to


def automaton(codes: np.ndarray) -> Table:
    """The suffix automaton of a sequence of codes as a transition table.

    State 0 is dead and state 1 the root, so a path from the root exists for exactly the sequence's factors.
    """
    link, length, nxt = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.zeros((len(nxt), DENSE), np.int32)
    rare = []
    for s, row in enumerate(nxt):
        for c, t in row.items():
            if c < DENSE:
                out[s, c] = t
            else:
                rare.append((s << 32 | c, t))
    rare.sort()
    return Table(out.ravel(), np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32))


def encode(text: str, lut: np.ndarray) -> np.ndarray:
    return lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Model:
    """One automaton per language, and what a phrase costs in it: the logarithm of the size of its text."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.lut = letters("".join(samples[k] for k in self.langs))
        coded = [encode(samples[k], self.lut) for k in self.langs]
        coded = [c[(c != 1) | np.r_[True, c[:-1] != 1]] if len(c) else c for c in coded]  # runs of other characters count once
        self.tables = [automaton(c) for c in coded]
        self.cost = [math.log2(max(2, len(c))) for c in coded]

    @staticmethod
    def _advance(state: np.ndarray, col: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
        """The states after one code each (0 pads and changes nothing), and how many phrases that ended."""
        to = table.step(state, col)
        pad = col == 0
        miss = (to == 0) & ~pad
        back = table.step(1, col[miss])
        n = np.zeros(len(col), np.int8)
        n[miss] = (state[miss] != 1).astype(np.int8) + (back == 0)  # a character that the sample lacks is a phrase
        to[miss] = np.where(back == 0, 1, back)
        return np.where(pad, state, to), n

    def parse(self, codes: np.ndarray, table: Table, first: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases that end in each piece, and the state after it; codes is (place, piece), 0 pads a piece's end.

        A phrase is the longest factor that the automaton holds. A piece marked `first` begins in its `start`, any
        other where the piece before it ended. All are parsed from a guess (the root) at once; one whose guess was
        wrong is parsed again, until it comes into the state that the guess had led to: from there on both agree.
        """
        width, n = codes.shape
        begin = np.where(first, start, 1).astype(np.int32)
        states, ended = np.empty((width, n), np.int32), np.zeros((width, n), np.int8)
        state = begin
        for c in range(width):
            if not codes[c].any():
                states[c:] = state
                break
            state, ended[c] = self._advance(state, codes[c], table)
            states[c] = state
        while True:
            should = np.where(first, start, np.r_[np.int32(1), states[-1, :-1]]).astype(np.int32)
            live = np.flatnonzero(should != begin)
            if not len(live):
                return ended.sum(axis=0, dtype=np.int64), states[-1]
            begin, state = should, should[live]
            for c in range(width):
                state, ended[c, live] = self._advance(state, codes[c, live], table)
                apart = state != states[c, live]
                states[c, live] = state
                live, state = live[apart], state[apart]
                if not len(live):
                    break

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of the cheapest parse (ties: the first by name) and 1 - its cost / the next one's."""
        lang, score = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        phrases = np.zeros((len(texts), len(self.langs)), np.int64)
        alpha = np.zeros(len(texts), bool)
        state = np.ones((len(texts), len(self.langs)), np.int32)  # where each text's parse is
        rows: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        lanes = 0

        def flush() -> None:
            nonlocal lanes
            if rows:
                codes, own = np.ascontiguousarray(np.concatenate(rows).T), np.concatenate(owner)
            if rows and len(own):
                first = np.r_[True, own[1:] != own[:-1]]
                last = np.r_[first[1:], True]
                for k, t in enumerate(self.tables):
                    n, end = self.parse(codes, t, first, state[own, k])
                    np.add.at(phrases[:, k], own, n)
                    state[own[last], k] = end[last]
            rows.clear()
            owner.clear()
            lanes = 0

        for i, text in enumerate(texts):
            before = 0
            for at in range(0, len(text or ""), LANES * PIECE):
                c = encode(text[at : at + LANES * PIECE], self.lut)
                alpha[i] |= bool((c >= 2).any())
                c, before = c[(c != 1) | np.r_[before != 1, c[:-1] != 1]], c[-1]
                c = np.pad(c, (0, -len(c) % PIECE)).reshape(-1, PIECE)
                rows.append(c)
                owner.append(np.full(len(c), i))
                lanes += len(c)
                if lanes >= LANES:
                    flush()
        flush()
        cost = (phrases + (state != 1)) * np.array(self.cost)  # the phrase that the text's end cuts counts too
        for i in np.flatnonzero(alpha):
            order = np.argsort(cost[i], kind="stable")
            lang[i] = self.langs[order[0]]
            score[i] = float(1 - cost[i, order[0]] / cost[i, order[1]]) if len(order) > 1 else 1.0
        return lang, score


_models: dict[tuple, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    key = tuple(sorted(samples.items()))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_samples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Labelled text by language: DOCS_PER_LANG documents by the hash of their ids, an equal share of CHARS_PER_LANG of each.

    This bounded sample is all that is learnt from and all that reaches the driver. A document's share is taken from
    the middle of its text.
    """
    share = 2 * CHARS_PER_LANG // DOCS_PER_LANG
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    start = F.greatest(F.lit(1), (F.length(text_col) / 2).cast("int") - share // 2)
    rows = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.substring(F.col(text_col), start, F.lit(share)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    parts: dict[str, list[str]] = {}
    for r in rows.withColumn("rank", rank).filter(F.col("rank") <= DOCS_PER_LANG).orderBy("lang", "rank").collect():
        parts.setdefault(r["lang"], []).append(r["part"])
    return {k: "\n".join(v)[:CHARS_PER_LANG] for k, v in parts.items()}


def identify(docs: DataFrame, samples: dict[str, str], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and lang_pred, score of every row, each whole text parsed against every language.

    The language that needs the fewest phrases, each weighed by the logarithm of its automaton's text, wins. Null texts
    and those without a letter are `und` with score 0, as is everything if nothing was learnt; with one language every
    text with a letter has it, with score 1. Rows are judged each by itself, so ties and repeats change nothing. Texts
    of any length are parsed whole, as one sequence. Columns named lang_pred and score are replaced, others kept; an
    empty table gives no rows.
    """
    keep = keep or [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(*keep, F.col(text_col))  # read by place, so no name can clash
    out = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        for b in batches:
            lang, score = model.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, out.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = training_samples(docs)
    scored = identify(docs.withColumn("held_out", held_out()), samples, keep=["doc_id", "held_out"])
    return Scratch(spark).write(scored, "langid", rows=ARROW_ROWS)
