"""WARC archives: a native writer, and a reader that verifies record boundaries as a chain (operator 1)."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settings, table

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: Bytes of a file that one task scans.
SPLIT_BYTES = 4 << 20
#: Payloads of at least so many bytes are compared; smaller ones are always written in full.
MIN_BYTES = 0
#: Bytes of archives that one reading task takes at least, once each core has some.
TASK_BYTES = 128 << 20
#: Repeated digests that are broadcast (under 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: The base32 digits, a fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of bytes: each five hex digits are four base32 digits."""
    h = F.sha1(data)
    word = [F.conv(F.substring(h, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(w, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for w in word for s in (15, 10, 5, 0)])


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = MIN_BYTES, date: str = "2025-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A WARC record per row under `path`, written by Spark's own text writer (so by its commit protocol, anywhere).

    Of equal payloads of at least `min_bytes` the row of the smallest id is a response, all others revisit it; rows
    that repeat that id and payload are responses too. A null payload is empty; a null id counts after all others and
    is nobody's target; a null url has no target line, and line ends in a url are percent-encoded. No html is
    shuffled: digests are counted alone, and only those that repeat meet the rows again. An empty table gives archives
    without records; rows that repeat an id have records of that same id. Columns of other names are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", sha1_base32(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("n"))
    spark = pages.sparkSession
    scratch = Scratch(spark)
    repeated = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    repeated = scratch.write(repeated.filter("c > 1").select("digest", "first"), "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(HTTP_HEAD), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END.decode()).mode("overwrite").text(path)


class _File:
    """Ranges of a file in any file system that Arrow knows."""

    def __init__(self, uri: str, length: int):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))
        self.file, self.length, self.at, self.data = system.open_input_file(path), length, 0, b""

    def load(self, start: int, end: int) -> None:
        end = min(end, self.length)
        self.at, self.data = start, self.file.read_at(max(0, end - start), start)

    def bytes(self, start: int, end: int) -> bytes:
        if start >= self.at and end <= self.at + len(self.data):
            return self.data[start - self.at : end - self.at]
        return self.file.read_at(max(0, min(end, self.length) - start), start)

    def line(self, off: int) -> bytes | None:
        """The bytes from `off` up to the next line end; None if the file ends before one."""
        if self.at <= off and (k := self.data.find(b"\r\n", off - self.at)) >= 0:
            return self.data[off - self.at : k]
        step = 2048
        while True:
            raw = self.bytes(off, min(off + step, self.length))
            if (k := raw.find(b"\r\n")) >= 0:
                return raw[:k]
            if off + step >= self.length:
                return None
            step *= 4

    def header(self, off: int) -> tuple[dict[str, str], int] | None:
        """The fields of the record at `off` and where its block begins; None if no record is there.

        Fields are read line by line up to the first that is none. Magic is no field, so what is read at all places that
        look like records is linear in the bytes, also where payloads are nothing but magic.
        """
        if self.bytes(off, min(off + len(MAGIC), self.length)) != MAGIC:
            return None
        fields, at = {}, off + len(MAGIC)
        while x := self.line(at):
            name, colon, value = x.partition(b":")
            if not colon:
                return None
            fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
            at += len(x) + 2
        if x is None or not re.fullmatch(r"\d+", fields.get("content-length", "")):
            return None
        return fields, at + 2


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: every place that looks like a record, and where its chain of successors leaves the split."""
    for b in batches:
        for path, length, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            f, end = _File(path, length), min(start + size, length)
            f.load(start, end + len(MAGIC) - 1)
            nxt, k = {}, f.data.find(MAGIC)
            while 0 <= k < end - start:
                if h := f.header(start + k):
                    nxt[start + k] = h[1] + int(h[0]["content-length"]) + len(END)
                k = f.data.find(MAGIC, k + 1)
            leave: dict[int, int] = {}
            for off in sorted(nxt, reverse=True):
                to = nxt[off]
                leave[off] = leave.get(to, -1) if to < end else to if to <= length else -1
            rows = [(path, off, to) for off, to in sorted(leave.items()) if to >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "off", "leave"])


def _spread(work: DataFrame, *keys: str) -> DataFrame:
    """`work` (splits, or entries of splits) dealt to tasks by the bytes that its rows stand for, not by the rows' own."""
    n, size = work.agg(F.count(F.lit(1)), F.max("size")).first()
    cores = work.sparkSession.sparkContext.defaultParallelism
    return work.repartition(max(1, -(-n * (size or 0) // TASK_BYTES), min(n, 2 * cores)), *keys)


def record_entries(splits: DataFrame, scratch: Scratch, longest: int) -> DataFrame:
    """(path, off): of each split the first record that the chain from the file's start reaches.

    Pointer jumping: in each round the pointers double their reach (over splits, as each task has already followed its
    own), and places that are reached reach on. Magic inside a payload is no place that a chain from the start leads to.
    """
    found = scratch.write(_spread(splits, "path", "start").select("path", "length", "start", "size").mapInArrow(_candidates, "path string, off long, leave long"), "candidates", rows=1)
    targets = found.select("path", F.col("leave").alias("off")).distinct()
    jump = found.filter("off > 0").join(targets, ["path", "off"], "left_semi").unionByName(found.filter("off = 0"))
    jump = scratch.write(jump, "jump0")
    reached = splits.filter("start = 0").select("path", F.col("start").alias("off"))  # of files that begin with no record too
    for i in range(math.ceil(math.log2(longest + 1)) if longest > 1 else 0):
        more = reached.join(jump, ["path", "off"]).select("path", F.col("leave").alias("off"))
        reached = scratch.write(reached.unionByName(more).distinct(), f"reached{i + 1}")
        far = jump.select("path", F.col("off").alias("leave"), F.col("leave").alias("far"))
        jump = scratch.write(jump.join(far, ["path", "leave"]).select("path", "off", F.col("far").alias("leave")), f"jump{i + 1}")
    return reached


def read_warc(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of the WARC files under `path`: path, off, record_type, record_id, target_uri, refers_to, digest,
    payload_bytes, and with `payload` the payload (empty for a revisit).

    payload_bytes and digest (bare base32) are those of the bytes read; for a revisit, which has none, those that its
    head and HTTP head state. Files are read in splits of `split_bytes`, whatever their records; a record that begins
    in a split is read to its end. Empty files have no records. Where a file's chain breaks (no record where one should
    be, or one that the file's end cuts) the job fails with the file and the place; if not `strict`, a row of type
    `broken` with nothing but the path and the place stands there, and the file is read up to it.
    """
    scratch = Scratch(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")).withColumn("size", F.lit(split_bytes))
    splits = scratch.write(splits, "splits")
    longest = splits.agg(F.max((F.col("start") / split_bytes).cast("int") + 1)).first()[0] or 0
    entries = record_entries(splits, scratch, longest)
    begin = (F.col("off") - F.col("off") % split_bytes).alias("start")
    work = splits.join(entries.select("path", "off", begin), ["path", "start"]).select("path", "length", (F.col("start") + F.col("size")).alias("end"), "off", "size")
    work = scratch.write(work, "work")
    schema = "path string, off long, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_bytes long" + (", payload binary" if payload else "")
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for where, length, end, off in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                f, rows, held = _File(where, length), [], 0
                f.load(off, end)
                while off < min(end, length):
                    fields, at = f.header(off) or ({}, length + 1)
                    stop = at + int(fields.get("content-length", 0))
                    if stop > length:
                        if strict:
                            raise ValueError(f"{where}: the chain of records breaks at byte {off} of {length}")
                        rows.append((where, off, "broken", *[None] * (len(kinds) - 3 - (not payload))))
                        break
                    block = f.bytes(at, stop)
                    head, _, body = block.partition(END)
                    kind = fields.get("warc-type")
                    if kind == "revisit":
                        n = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
                        size, digest = int(n[1]) if n else None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    row = (where, off, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size)
                    rows.append((*row, body) if payload else row)
                    held += len(body) if payload else 0
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                    off = stop + len(END)
                if rows:
                    yield batch(rows)

    return scratch.write(_spread(work, "path", "off").mapInArrow(extract, schema), "records", rows=1)


def archive_round_trip(pages: DataFrame, *, min_bytes: int = MIN_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    The archives are removed when what they hold is read and written; use write_warc to keep some.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = scratch.paths["warc"] = f"{scratch.root}/warc"
    write_warc(pages, path, min_bytes=min_bytes)
    records = read_warc(spark, path, split_bytes=split_bytes, payload=False)
    scratch.drop("warc")
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(x, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS x
  FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS f FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, x AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM m
"""
