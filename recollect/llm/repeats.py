"""Seeds of repeated windows of token sequences: winnowed anchors are joined, and matches extended both ways from them.

A window is `win` consecutive tokens of one text. Each window has one anchor, the k-gram of the smallest hash in it
(the last of equal ones), so equal windows have equal anchors at equal places. The windows of one anchor form its span.
Occurrences of an anchor are joined on its hash; where whole spans agree, the match extends over every window of the
span at once. Where spans of one anchor differ, the match is first extended by half of what a window has beside its
anchor: two equal windows agree in that half to the left or to the right of it, so only windows on a side that agrees
are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Tokens hashed at once; positions within a chunk take PLACE bits.
CHUNK, PLACE = 1 << 18, np.uint64((1 << 20) - 1)
#: Documents in one Arrow batch.
ROWS = 1000
#: Occurrences that a task sorts out together, and those of one anchor beyond which it no longer holds them back.
BUFFER, HOT = 200_000, 1_000_000
WHOLE, CHECK, CHECK_TWICE = 0, 1, 2


def _powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def powers(m: int) -> tuple[np.ndarray, np.ndarray]:
    if m not in _pow:
        _pow[m] = _powers(m, 2 * CHUNK)
    return _pow[m]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix(x: np.ndarray, m: int = M1) -> np.ndarray:
    return np.r_[np.zeros(1, np.uint64), np.cumsum(x * powers(m)[0][: len(x)], dtype=np.uint64)]


def span_hash(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: int = M1) -> np.ndarray:
    """The hash of tokens lo..hi-1: equal sequences have equal hashes wherever they stand."""
    return mix((p[hi] - p[lo]) * powers(m)[1][lo])


def word_tokens(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(M2))


def byte_tokens(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def anchors(x: np.ndarray, end: np.ndarray, win: int, k: int) -> tuple[np.ndarray, ...]:
    """(lo, n, anchor, span, place, left, right) of a chunk of tokens; end[i] is where token i's text ends in the chunk.

    place is where the anchor stands from lo on; left and right are 16-bit hashes of the half windows beside it, 0 where
    no window of the span reaches so far.
    """
    n, w = len(x), win - k + 1
    if n < win:
        return _nothing()
    p = prefix(x)
    i = np.arange(n - k + 1)
    h = span_hash(p, i, i + k)
    low = (h & ~PLACE) | (PLACE - i.astype(np.uint64))
    span = 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if w > span:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    s = np.flatnonzero(np.arange(n - win + 1) + win <= end[: n - win + 1])
    at = (PLACE - (low[s] & PLACE)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]) if len(s) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(s)])
    lo, at = s[first], at[first]
    sp = mix(span_hash(p, lo, lo + count - 1 + win) + (at - lo).astype(np.uint64) * np.uint64(M2) + count.astype(np.uint64))
    half = (win - k + 1) // 2
    left, right = np.zeros(len(lo), np.uint16), np.zeros(len(lo), np.uint16)
    i = np.flatnonzero(at - lo >= half)
    left[i] = (span_hash(p, at[i] - half, at[i]) >> np.uint64(48)).astype(np.uint16) | 1
    i = np.flatnonzero(lo + count - 1 + win - at - k >= half)
    right[i] = (span_hash(p, at[i] + k, at[i] + k + half) >> np.uint64(48)).astype(np.uint16) | 1
    return lo, count, h[at], sp, at - lo, left, right


def _nothing() -> tuple[np.ndarray, ...]:
    z = np.empty(0, np.int64)
    return z, z, z.astype(np.uint64), z.astype(np.uint64), z, z.astype(np.uint16), z.astype(np.uint16)


def sketch(texts: list[bytes], tokens: Callable[[bytes], np.ndarray], win: int, k: int) -> tuple[np.ndarray, ...]:
    """doc and what `anchors` gives of a batch, chunk by chunk; a long text is cut into chunks that overlap by a window."""
    out, xs, docs, offs, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if xs:
            lens = np.array([len(x) for x in xs])
            ends = np.cumsum(lens)
            lo, *rest = anchors(np.concatenate(xs), np.repeat(ends, lens), win, k)
            piece = np.searchsorted(ends, lo, side="right")
            out.append((np.array(docs)[piece], lo - (ends - lens)[piece] + np.array(offs)[piece], *rest))
        xs.clear()
        docs.clear()
        offs.clear()
        size = 0

    for d, t in enumerate(texts):
        x = tokens(t)
        for c in range(0, max(0, len(x) - win + 1), CHUNK):
            part = x[c : c + CHUNK + win - 1]
            if size + len(part) > CHUNK:
                flush()
            xs.append(part)
            docs.append(d)
            offs.append(c)
            size += len(part)
    flush()
    if not out:
        return (np.empty(0, np.int64), *_nothing())
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _shared(a: np.ndarray, side: np.ndarray, dk: np.ndarray, weight: np.ndarray, earlier: bool) -> np.ndarray:
    """Whether a row's half window beside the anchor is another's too (`earlier`: of another dk)."""
    order = np.lexsort((side, a))
    at = np.flatnonzero(_starts(a[order], side[order]))
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(a)]))
    if earlier:
        more = (np.minimum.reduceat(dk[order], at) < np.maximum.reduceat(dk[order], at))[group]
    else:
        more = (np.add.reduceat(weight[order], at) > 1)[group]
    out = np.empty(len(a), bool)
    out[order] = more
    return out & (side > 0)


def judge(dk, a, sp, flag, left, right, earlier: bool, hot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurrence whether its whole span is met again, what to check of it (0 nothing), and on which sides.

    Rows are sorted by (anchor, span, dk); flag is 2 for one that stands for several. `earlier`: only what a smaller dk
    has counts as met, and the first of a span is marked whole too if later ones rest on it. `hot`: the rows are but a
    part of their anchor's, so one of each span is checked on both sides whatever the others hold.
    """
    n = len(a)
    kind, whole, near = np.zeros(n, np.int8), np.zeros(n, bool), (np.full(n, hot), np.full(n, hot))
    if not n:
        return whole, kind, *near
    new_a, new_s = _starts(a), _starts(a, sp)
    ia, is_ = np.flatnonzero(new_a), np.flatnonzero(new_s)
    group_a, group_s = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
    mixed = np.add.reduceat(new_s.astype(np.int64), ia)[group_a] > 1  # the anchor has several spans
    weight = np.add.reduceat(flag.astype(np.int64), is_)[group_s]
    if earlier:
        first = dk == dk[is_][group_s]
        whole = (np.add.reduceat((~first | (flag > 1)).astype(np.int64), is_) > 0)[group_s]
        ask = first & (hot | (mixed & (np.minimum.reduceat(dk, ia) < np.maximum.reduceat(dk, ia))[group_a]))
    else:
        whole = weight > 1
        ask = new_s & (hot | (mixed & (np.minimum.reduceat(weight, ia) == 1)[group_a]))  # one row of each span, if any is seen once
    i = np.flatnonzero(ask)
    if len(i):
        for side, at in zip((left, right), near, strict=True):
            at[i] |= _shared(a[i], side[i], dk[i], np.ones(len(i), np.int64), earlier)
        i = i[near[0][i] | near[1][i]]
        kind[i] = np.where((weight[i] > 1) & (not earlier), CHECK_TWICE, CHECK)
    return whole, kind, *near


def candidates(docs: DataFrame, scratch: Scratch, *, tokens: Callable[[bytes], np.ndarray], win: int, k: int, earlier: bool, hot: int = HOT) -> DataFrame:
    """(dk, th, lo, n, kind): runs of window starts that may be repeated (`earlier`: that a smaller dk may have).

    docs has (dk, th, text as bytes). WHOLE: the whole span of an anchor is met again (64 bits of it, beside 64 of its
    anchor, say so); with `earlier` the first one is listed as well. CHECK: some of the run's windows may be, since a
    half window beside the anchor is met again (CHECK_TWICE: it stands for several). No repeated window is missed.

    Occurrences are rows that Spark sorts by anchor (and spills); a task holds those of one anchor at a time. What one
    batch can decide is decided before, so a passage that many documents share sends one row a batch. An anchor of more
    than `hot` occurrences left is not held: one occurrence of each of its spans is checked whole.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dk, th = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            doc, lo, n, a, sp, place, left, right = sketch([t or b"" for t in b.column(2).to_pylist()], tokens, win, k)
            if not len(doc):
                continue
            # Decide inside the batch: of equal (anchor, span) the first goes on for all, the rest are done.
            order = np.lexsort((lo, dk[doc], sp, a))
            doc, lo, n, a, sp, place, left, right = (x[order] for x in (doc, lo, n, a, sp, place, left, right))
            new = _starts(a, sp)
            at = np.flatnonzero(new)
            size = np.repeat(np.diff(np.r_[at, len(a)]), np.diff(np.r_[at, len(a)]))
            if earlier:
                same = dk[doc] == np.repeat(dk[doc[at]], np.diff(np.r_[at, len(a)]))
                later = np.repeat(np.add.reduceat((~same).astype(np.int64), at), np.diff(np.r_[at, len(a)])) > 0
                flag = np.where(same, 1 + later, 0)
            else:
                flag = np.where(new, np.minimum(size, 2), 0)
            key = np.where(flag > 0, a, mix(th[doc].view(np.uint64)))  # what is done is only passed on, anywhere
            where = (lo.astype(np.int64) << 32) | (n.astype(np.int64) << 18) | (place.astype(np.int64) << 4) | flag
            sides = (left.astype(np.int64) << 16) | right
            cols = (key.view(np.int64), sp.view(np.int64), dk[doc], th[doc], where, sides)
            order = np.lexsort((lo, doc))  # a document's rows stand together and share most of their bytes
            cols = tuple(x[order] for x in cols)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "sp", "dk", "th", "at", "sides"])

    def settle(cols: list[np.ndarray], is_hot: bool) -> Iterator[pa.RecordBatch]:
        a, sp, dk, th, at, sides = cols
        lo, n, place, flag = at >> 32, (at >> 18) & 0x3FFF, (at >> 4) & 0x3FFF, at & 15
        left, right = sides >> 16, sides & 0xFFFF

        def rows(i: np.ndarray, lo: np.ndarray, n: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (dk[i], th[i], lo.astype(np.int32), n.astype(np.int32), kind.astype(np.int32))], ["dk", "th", "lo", "n", "kind"])

        done, i = np.flatnonzero(flag == 0), np.flatnonzero(flag > 0)
        whole, kind, by_left, by_right = judge(dk[i], a[i], sp[i], flag[i], left[i], right[i], earlier, is_hot)
        done = np.r_[done, i[whole]]
        yield from rows(done, lo[done], n[done], np.zeros(len(done)))
        # A shared left half asks for the windows that start before it, a shared right half for those that end after it.
        ask = kind > 0
        i, kind, by_left, by_right = i[ask], kind[ask], by_left[ask], by_right[ask]
        half, mid = (win - k + 1) // 2, lo[i] + place[i]
        first = np.where(by_left, lo[i], np.maximum(lo[i], mid + k + half - win))
        last = np.where(by_right, lo[i] + n[i] - 1, np.minimum(lo[i] + n[i] - 1, mid - half))
        yield from rows(i, first, last - first + 1, kind)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor: all whole anchors of a buffer are settled, the last one waits for its other rows."""
        parts: list[list[np.ndarray]] = []
        size, is_hot = 0, None

        def work(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, is_hot
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            cut = len(cols[0]) if end else int(np.searchsorted(cols[0], cols[0][-1]))
            head = int(np.searchsorted(cols[0], is_hot, side="right")) if is_hot is not None and cols[0][0] == is_hot else 0
            if head:
                yield from settle([c[:head] for c in cols], True)
            if cut > head:
                yield from settle([c[head:cut] for c in cols], False)
            rest = [c[max(head, cut) :] for c in cols]
            if len(rest[0]) > hot:
                yield from settle(rest, True)
                is_hot, rest = rest[0][-1], [c[:0] for c in cols]
            parts, size = [rest], len(rest[0])

        for b in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if sum(len(x[0]) for x in parts[1:]) >= min(BUFFER, hot):
                yield from work(False)
        if size:
            yield from work(True)

    found = docs.select("dk", "th", "text").mapInArrow(emit, "a long, sp long, dk long, th long, at long, sides long")
    found = found.repartition("a").sortWithinPartitions("a", "sp", "dk")
    return scratch.write(found.mapInArrow(decide, "dk long, th long, lo int, n int, kind int"), "known", rows=ROWS)


def packed(n: str = "n", kind: str | None = None) -> Column:
    """A run (lo, n and its kind) as one number, cheap to gather and to read in Python."""
    return F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.shiftleft(F.col(n).cast("long"), 2)).bitwiseOR(F.col(kind).cast("long") if kind else F.lit(0).cast("long"))


def runs(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, n, kind) of each row of a column of packed runs; a null row has none."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    lo, n, kind = flat >> 32, (flat >> 2) & 0x3FFFFFFF, flat & 3
    for i, j in zip((end - size).tolist(), end.tolist(), strict=True):
        yield lo[i:j], n[i:j], kind[i:j]


def covered(lo: np.ndarray, n: np.ndarray, size: int, win: int) -> np.ndarray:
    """Which of `size` tokens lie in a window of the runs: overlapping repeats merge into maximal ones."""
    edge = np.zeros(size + 1, np.int64)
    if len(lo):
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n - 1 + win, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(edges: list[np.ndarray]) -> pa.Array:
    """Removed runs (at, len) of each row, from where they begin and end in turn."""
    flat = np.concatenate(edges) if edges else np.empty(0, np.int64)
    ends = np.cumsum([0, *(len(e) // 2 for e in edges)], dtype=np.int32)
    rows = pa.StructArray.from_arrays([pa.array(flat[::2].astype(np.int32)), pa.array((flat[1::2] - flat[::2]).astype(np.int32))], ["at", "len"])
    return pa.ListArray.from_arrays(pa.array(ends), rows)
