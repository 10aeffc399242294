"""Stated sets in blocks that are small enough to broadcast."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a set that are broadcast at once; more go in more blocks, each with a pass of its own.
BROADCAST_ROWS = 20_000


def per_block(small: DataFrame, run: Callable[[DataFrame], DataFrame], limit: int = BROADCAST_ROWS) -> DataFrame:
    """The union of run(broadcast block) over the blocks of `small`, which is counted first."""
    n = max(1, -(-small.count() // limit))
    parts = [small] if n == 1 else [small.filter(F.pmod(F.xxhash64(*small.columns[:1]), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.unionByName, [run(F.broadcast(p)) for p in parts])
