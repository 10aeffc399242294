"""Sharding by a hierarchical weighted hash tree (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Sub-buckets of a shard, by hash; slots are counted within each, so no task sorts a whole shard.
SUB_BUCKETS = 4096
#: Offsets that are broadcast (under 32 MB); for more shards they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Node:
    """A region, a rack or (with `shard` set) a shard. An inner node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """`shards` equal shards dealt over regions and racks; numbered region by region."""
    per = [[len(range(g * racks + r, shards, regions * racks)) for r in range(racks)] for g in range(regions)]
    nxt, out = 0, []
    for g in range(regions):
        rows = []
        for r in range(racks):
            leaves = tuple(Node(f"g{g}/r{r}/s{nxt + i}", shard=nxt + i) for i in range(per[g][r]))
            nxt += len(leaves)
            if leaves:
                rows.append(Node(f"g{g}/r{r}", leaves))
        if rows:
            out.append(Node(f"g{g}", tuple(rows)))
    return Node("", tuple(out))


def add_shard(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: no other subtree's weight changes, so rows move only into it."""
    g = f"g+{shard}"
    return Node("", (*tree.children, Node(g, (Node(f"{g}/r0", (Node(f"{g}/r0/s{shard}", own_weight=weight, shard=shard),)),))))


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw at rate `weight`: the child with the smallest wins with probability weight / sum."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node.name}"))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that `key` (a string) reaches from the root; a draw decides at each level with several children."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard of positive weight")
    if len(live) == 1:
        return shard_of(key, live[0])
    draws = [_draw(key, c) for c in live]
    best = F.least(*draws)
    out = shard_of(key, live[-1])
    for c, d in reversed(list(zip(live[:-1], draws[:-1], strict=True))):
        out = F.when(d == best, shard_of(key, c)).otherwise(out)
    return out


def leaves(tree: Node) -> int:
    """How many shards a tree has."""
    return 1 if tree.shard is not None else sum(map(leaves, tree.children))


def with_slots(df: DataFrame, shard: str, order: list[str], shards: int, sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: an offset per (shard, sub-bucket) plus the rank inside the sub-bucket.

    The offsets table has at most shards x sub_buckets rows, whatever the input; it is broadcast if they are few.
    """
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    sub = F.pmod(F.conv(F.substring(name, 1, 8), 16, 10).cast("long"), F.lit(sub_buckets)).cast("int")
    df = df.withColumn("_sub", sub)
    counts = df.groupBy(shard, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_s"), F.col("_sub").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(shard, "_sub").orderBy(*order))
    few = shards * sub_buckets <= BROADCAST_ROWS
    joined = df.withColumn("_rank", rank).join(F.broadcast(offsets) if few else offsets, (F.col(shard) == F.col("_s")) & (F.col("_sub") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_sub", "_s", "_b", "_before", "_rank")


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is `key`: the id and the tree alone decide, so copies of a row stay together and rows of equal texts need
    not. A null id is a key of its own (the empty string); a null text has size 1 and the CRC of no bytes; rows that
    are equal in id and text take neighbouring slots in any order. Texts of any length are read whole, an empty table
    gives no rows, and other columns are not read.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).cast("int").alias("shard"),
        (shard_of(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(base, "shard", ["doc_id", "text_crc32", "size"], leaves(tree)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


SHARDS = 16


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(SHARDS)
    return shard_documents(table(spark, sf_dir, "documents"), tree, add_shard(tree, SHARDS))


def shard_sql(key: str, tree: Node) -> str:
    """`shard_of` as SQL text."""
    if tree.shard is not None:
        return str(tree.shard)
    live = [c for c in tree.children if c.weight > 0]
    if len(live) == 1:
        return shard_sql(key, live[0])
    draws = [f"(-ln((CAST('0x' || substr(md5({key} || '|{c.name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {c.weight})" for c in live]
    whens = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {shard_sql(key, c)}" for c, d in zip(live[:-1], draws[:-1], strict=True))
    return f"CASE {whens} ELSE {shard_sql(key, live[-1])} END"


_TREE = even_tree(SHARDS)
# The CRC's table comes from its rule: eight shifts by the reversed polynomial 0xEDB88320.
OP8_SQL = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], list_transform(range(0, 8), lambda z: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, k, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM b, t),
s AS (
  SELECT doc_id, size, text_crc32, {shard_sql('k', _TREE)} AS shard, {shard_sql('k', add_shard(_TREE, SHARDS))} AS grown_shard,
    CAST('0x' || substr(md5(k || '|' || CAST(text_crc32 AS VARCHAR) || '|' || CAST(size AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS sub
  FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM s
"""
