"""Tamper evidence: row fingerprints, checkpoints in a digest chain, a monotonic witness, and guarded reads."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import schema_digest
from ..sources.files import create_once, names, read_text
from ..sources.scratch import shared_dir

GENESIS = "0" * 64


class IntegrityError(RuntimeError):
    """Rows are not what was sealed; they must not be served."""


class WitnessConflict(IntegrityError):
    """A checkpoint that does not follow the last one witnessed."""


def canonical(value: object) -> bytes:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode()


def encoded(c: str, kind: T.DataType) -> Column:
    """A value as text that no other value of its type has; null stays null."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)), {"ignoreNullFields": "false"})
    if isinstance(kind, T.ArrayType | T.StructType):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return F.base64(c) if isinstance(kind, T.BinaryType) else F.col(c).cast("string")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's columns, each as its length in bytes, a colon and its text, or as a hyphen if it is null.

    Lengths say where a value ends, so rows that differ in any column, vectors included, have different texts.
    """
    parts = [encoded(c, df.schema[c].dataType) for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(fingerprint, n) of a small table, its rows' hashes in key order."""
    rows = df.select(F.col(key).alias("k"), row_hash(df, columns).alias("h")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("rows"))
    return rows.select(F.sha2(F.array_join(F.transform("rows", lambda x: x["h"]), ""), 256).alias("fingerprint"), F.size("rows").cast("long").alias("n"))


#: Keys of one block: what a change costs to seal, and a single row to verify.
BLOCK = 10_000


def block_hashes(df: DataFrame, key: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(b, h, n): the hash of the rows of each block of `block` keys, in key order, made in one task, and their number."""
    rows = df.select(F.col(key).alias("k"), F.expr(f"{key} div {int(block)}").alias("b"), row_hash(df, columns).alias("h"))
    per = rows.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("r"))
    return per.select("b", F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("h"), F.size("r").cast("long").alias("n"))


def top_hash(blocks: DataFrame) -> DataFrame:
    """(fingerprint, n) of a table from the hashes of its blocks: with 10,000 rows a block a row of ten thousandths of its size."""
    top = blocks.agg(F.array_sort(F.collect_list(F.struct("b", "h"))).alias("r"), F.sum("n").alias("n"))
    return top.select(F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("fingerprint"), F.col("n").cast("long").alias("n"))


def block_fingerprint(df: DataFrame, key: str, columns: list[str], block: int = 100_000) -> DataFrame:
    """(fingerprint, n) of a table of any size: hashes of blocks of `block` keys, each made in one task, then of those."""
    return top_hash(block_hashes(df, key, columns, block))


def is_digest(c: Column) -> Column:
    return F.rlike(c, F.lit("^[0-9a-f]{64}$"))


@dataclass(frozen=True)
class Checkpoint:
    """What was sealed: how many rows, their fingerprint and schema, and the digest of the checkpoint before."""

    stream_id: str
    agent: str
    sequence: int
    count: int
    head: str
    schema: str
    previous: str = GENESIS
    signature: str = ""

    def payload(self) -> bytes:
        return canonical({k: v for k, v in asdict(self).items() if k != "signature"})

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.payload()).hexdigest()

    def to_json(self) -> str:
        return canonical(asdict(self)).decode() + "\n"

    @staticmethod
    def from_json(text: str) -> Checkpoint:
        c = Checkpoint(**json.loads(text))
        if c.to_json() != text:
            raise IntegrityError("a checkpoint is not in its canonical form")
        if c.sequence < 1 or c.count < 0 or not all(re.fullmatch(r"[0-9a-f]{64}", x) for x in (c.head, c.schema, c.previous)):
            raise IntegrityError("a checkpoint's fields are invalid")
        return c


class HmacSigner:
    """Signs with a shared key; any object with sign and verify may stand in for it."""

    def __init__(self, key: bytes):
        self.key = key

    def sign(self, data: bytes) -> str:
        return base64.b64encode(hmac.new(self.key, data, hashlib.sha256).digest()).decode()

    def verify(self, data: bytes, signature: str) -> bool:
        return hmac.compare_digest(self.sign(data), signature)


class TrustStore:
    """Signs with one key and verifies with any that is trusted; a signature names its key."""

    def __init__(self, signers: dict[str, HmacSigner], active: str):
        self.signers, self.active = signers, active

    def sign(self, data: bytes) -> str:
        return f"{self.active}:{self.signers[self.active].sign(data)}"

    def verify(self, data: bytes, signature: str) -> bool:
        name, _, rest = signature.partition(":")
        return name in self.signers and self.signers[name].verify(data, rest)


class Witness:
    """Remembers the last checkpoint of each stream and takes only its successor."""

    def __init__(self) -> None:
        self.last: dict[str, Checkpoint] = {}

    def latest(self, stream_id: str) -> Checkpoint | None:
        return self.last.get(stream_id)

    def keep(self, c: Checkpoint) -> bool:
        self.last[c.stream_id] = c
        return True

    def advance(self, c: Checkpoint) -> None:
        old = self.latest(c.stream_id)
        if c.sequence != (old.sequence + 1 if old else 1) or c.previous != (old.digest if old else GENESIS):
            raise WitnessConflict(f"{c.stream_id}: checkpoint {c.sequence} does not follow {old.sequence if old else 'the start'}")
        if not self.keep(c):
            raise WitnessConflict(f"{c.stream_id}: another writer has sealed checkpoint {c.sequence}")


class StoredWitness(Witness):
    """A witness whose checkpoints are files, each written once, so it outlives the driver and serves several of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, stream_id: str) -> str:
        return f"{self.root}/{hashlib.sha256(stream_id.encode()).hexdigest()}"

    def latest(self, stream_id: str) -> Checkpoint | None:
        found = [n for n in names(self.spark, self._folder(stream_id)) if n.endswith(".json")]
        return Checkpoint.from_json(read_text(self.spark, f"{self._folder(stream_id)}/{found[-1]}")) if found else None

    def keep(self, c: Checkpoint) -> bool:
        return create_once(self.spark, f"{self._folder(c.stream_id)}/{c.sequence:020d}.json", c.to_json())


class Guard:
    """Seals an agent's rows and serves them only while they match the last seal.

    A seal signs the top of a hash tree: a hash per block of keys over all columns, and one over those. The blocks'
    hashes are kept as a table under `root`, named by their top, so a change hashes the blocks of the rows that it
    touches, and a row is verified by its block.
    """

    def __init__(self, stream_id: str, agent: str, signer: HmacSigner, witness: Witness, columns: list[str] | None = None, key: str = "id", *, root: str | None = None, block: int = BLOCK):
        self.stream_id, self.agent, self.signer, self.witness, self.columns, self.key, self.block = stream_id, agent, signer, witness, columns, key, block
        self.root = root or (f"{witness.root}/tree" if isinstance(witness, StoredWitness) else None)

    @property
    def checkpoint(self) -> Checkpoint | None:
        return self.witness.latest(self.stream_id)

    def _mine(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("agent") == self.agent)

    def _hashes(self, df: DataFrame) -> DataFrame:
        return block_hashes(df, self.key, self.columns or df.columns, self.block)

    def _tree(self, head: str, spark: SparkSession) -> DataFrame:
        if self.root is None:
            self.root = f"{shared_dir(spark)}/tree"
        return spark.read.schema("b long, h string, n long").parquet(f"{self.root}/{head}")

    def _kept(self, blocks: DataFrame) -> tuple[int, str]:
        """Stores the hashes of all blocks under their top; returns how many rows they have, and it."""
        spark = blocks.sparkSession
        if self.root is None:
            self.root = f"{shared_dir(spark)}/tree"
        r = top_hash(blocks).first()
        n, head = int(r["n"] or 0), r["fingerprint"] or GENESIS
        if not names(spark, f"{self.root}/{head}"):
            blocks.coalesce(1).write.mode("ignore").parquet(f"{self.root}/{head}")
        return n, head

    def _valid(self, df: DataFrame) -> Checkpoint:
        c = self.checkpoint
        if c is None or not self.signer.verify(c.payload(), c.signature):
            raise IntegrityError("no valid checkpoint")
        if c.schema != schema_digest(df.schema):
            raise IntegrityError(f"{self.agent}: the columns differ from checkpoint {c.sequence}")
        return c

    def _sealed(self, c: Checkpoint, spark: SparkSession) -> DataFrame:
        """The blocks' hashes of a checkpoint, which are not trusted but must have its top."""
        if not names(spark, f"{self.root}/{c.head}"):
            raise IntegrityError(f"{self.agent}: the hashes of checkpoint {c.sequence} are missing")
        tree = self._tree(c.head, spark)
        r = top_hash(tree).first()
        if (int(r["n"] or 0), r["fingerprint"] or GENESIS) != (c.count, c.head):
            raise IntegrityError(f"{self.agent}: the hashes of checkpoint {c.sequence} were changed")
        return tree

    def _advance(self, n: int, head: str, schema: str) -> Checkpoint:
        old = self.checkpoint
        c = Checkpoint(self.stream_id, self.agent, old.sequence + 1 if old else 1, n, head, schema, old.digest if old else GENESIS)
        c = replace(c, signature=self.signer.sign(c.payload()))
        self.witness.advance(c)
        return c

    def seal(self, df: DataFrame) -> Checkpoint:
        """Seals all of the agent's rows as they are."""
        n, head = self._kept(self._hashes(self._mine(df)))
        return self._advance(n, head, schema_digest(df.schema))

    def reseal(self, old: DataFrame, new: DataFrame, touched: list[int]) -> Checkpoint:
        """Seals a change of the rows with keys in the blocks `touched`, from the rows before and after it.

        The touched blocks must be as they were sealed before; all others keep their hashes, unread, so a change made
        behind the seal's back in any of them is still found.
        """
        c, spark = self._valid(old), old.sparkSession
        tree = self._sealed(c, spark)
        inside = F.expr(f"{self.key} div {self.block}").isin(touched)
        was = {tuple(r) for r in self._hashes(self._mine(old).filter(inside)).collect()}
        if was != {tuple(r) for r in tree.filter(F.col("b").isin(touched)).collect()}:
            raise IntegrityError(f"{self.agent}: rows to be changed differ from checkpoint {c.sequence}")
        n, head = self._kept(tree.filter(~F.col("b").isin(touched)).unionByName(self._hashes(self._mine(new).filter(inside))))
        return self._advance(n, head, schema_digest(new.schema))

    def verified(self, df: DataFrame) -> DataFrame:
        """The agent's rows, or IntegrityError; pass a pinned snapshot, so that what is checked is what is read."""
        c = self._valid(df)
        r = top_hash(self._hashes(self._mine(df))).first()
        if (c.count, c.head) != (int(r["n"] or 0), r["fingerprint"] or GENESIS):
            raise IntegrityError(f"{self.agent}: rows differ from checkpoint {c.sequence}")
        return self._mine(df)

    def verified_keys(self, df: DataFrame, keys: list[int]) -> DataFrame:
        """The agent's rows with these keys, or IntegrityError; only the blocks that they are in are read."""
        c, spark = self._valid(df), df.sparkSession
        blocks = sorted({abs(k) // self.block * (1 if k >= 0 else -1) for k in keys})
        rows = self._mine(df).filter(F.expr(f"{self.key} div {self.block}").isin(blocks))
        if {tuple(r) for r in self._hashes(rows).collect()} != {tuple(r) for r in self._sealed(c, spark).filter(F.col("b").isin(blocks)).collect()}:
            raise IntegrityError(f"{self.agent}: rows differ from checkpoint {c.sequence}")
        return rows.filter(F.col(self.key).isin(keys))


def witness_breaks(log: DataFrame) -> DataFrame:
    """Where a log of checkpoints (stream, at, sequence, digest, previous) does not go on by one or links elsewhere."""
    w = Window.partitionBy("stream").orderBy("at")
    j = log.withColumn("_s", F.coalesce(F.lag("sequence").over(w), F.lit(0))).withColumn("_d", F.coalesce(F.lag("digest").over(w), F.lit(GENESIS)))
    bad = F.when(F.col("sequence") != F.col("_s") + 1, "sequence").when(F.col("previous") != F.col("_d"), "link")
    return j.withColumn("problem", bad).filter(F.col("problem").isNotNull()).drop("_s", "_d")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one of two tables has; empty if and only if the sets of keys are equal."""
    x, y = (d.select(F.col(key).alias("key")).distinct() for d in (a, b))
    one = x.join(y, "key", "left_anti").select(F.lit("left").alias("side"), "key")
    return one.unionByName(y.join(x, "key", "left_anti").select(F.lit("right").alias("side"), "key"))
