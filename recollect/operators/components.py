"""Connected components by contraction: every round is a partial-aggregated minimum, two pointer jumps and a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, prefix: str = "cc") -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is one node of the component, the same for all of it.

    Each node points to its smallest neighbour or itself; pointers strictly fall, so jumping along them ends. Edges
    are then rewritten to the pointers' ends; those inside one end vanish. A node that is no local minimum is merged
    away each round, so few rounds are needed. A hub is only ever a key of a minimum or one side of a join that AQE
    can split; nothing is collected by node.
    """
    e = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{prefix}_e0")
    maps, i = [], 0
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        m = scratch.write(m, f"{prefix}_m{i}")
        for j in range(2):
            up = m.select(F.col("node").alias("root"), F.col("root").alias("above"))
            m = scratch.write(m.join(up, "root").select("node", F.col("above").alias("root")), f"{prefix}_m{i}_{j}")
        maps.append(m)
        low, high = m.select(F.col("node").alias("a"), F.col("root").alias("ra")), m.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(low, "a").join(high, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct()
        i += 1
        e = scratch.write(e, f"{prefix}_e{i}")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        up = out.select(F.col("node").alias("root"), F.col("root").alias("above"))
        out = scratch.write(maps.pop().join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"{prefix}_up{len(maps)}")
    return out
