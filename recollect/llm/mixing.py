"""Mixing sources to target weights by iterative proportional fitting (operator 4): DataFrame functions only."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

MARGINS = ("source", "lang", "topic")
#: Targets are shares in proportion to tokens ** TEMPER: 1 keeps a margin as it is, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
TOLERANCE, MAX_ROUNDS = 1e-9, 60
#: Share of all tokens that the sample of the query and of the pipeline is to hold (what the largest exact sample holds on sf0.1).
RATE = 0.65
#: A level whose expected tokens are off its wanted ones by more than this share counts as not met; so many are logged.
UNMET, LOGGED = 1e-3, 20
#: Rounds between two written tables.
ROUNDS_A_WRITE = 3


def token_count(text: Column) -> Column:
    """Words (runs of other than white space) of a whole text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by what a whole text holds: tables, addresses, many digits, or prose."""
    t = F.coalesce(text, F.lit(""))
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    return F.when(F.contains(t, F.lit(" | ")), "table").when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("://")), "address").when(digits * 20 > F.length(t), "numeric").otherwise("prose")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(level, share): the margin's levels with shares in proportion to tokens ** power."""
    return cells.groupBy(F.col(margin).alias("level")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, *, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """`cells` (the margins, tokens) with w: shares of 1 whose margins meet the targets (level, share).

    Each step scales the cells of a level by target / sum, margin after margin, until no margin is off by more than
    `tolerance` of its target or `max_rounds` have passed (targets that contradict each other end so). Target shares
    are normalised over the levels that have tokens; a level without a target gets nothing.
    """
    for m, t in targets.items():
        t = t.select(F.col("level").alias("_level"), F.col("share").cast("double").alias(f"t_{m}"))
        cells = cells.join(t, F.col(m).eqNullSafe(F.col("_level")), "left").drop("_level").withColumn(f"t_{m}", F.coalesce(f"t_{m}", F.lit(0.0)))
    cells = scratch.write(cells, "targets")
    for m in targets:
        levels = cells.filter("tokens > 0").groupBy(m).agg(F.max(f"t_{m}").alias("t"))
        total = levels.agg(F.sum("t")).first()[0] or 1.0
        cells = cells.withColumn(f"t_{m}", F.col(f"t_{m}") / F.lit(total))
    cells = scratch.write(cells.withColumn("w", F.col("tokens").cast("double")), "cells0")
    for i in range(0, max_rounds, ROUNDS_A_WRITE):
        step = cells
        for _ in range(ROUNDS_A_WRITE):
            for m in targets:
                step = step.withColumn("w", F.coalesce(F.col("w") * F.try_divide(F.col(f"t_{m}"), F.sum("w").over(Window.partitionBy(m))), F.lit(0.0)))
        cells = scratch.write(step, f"cells{i + 1}")
        off = [cells.groupBy(m).agg((F.abs(F.sum("w") - F.max(f"t_{m}")) / F.greatest(F.max(f"t_{m}"), F.lit(1e-300))).alias("x")).filter(F.col("x").isNotNull()).select("x") for m in targets]
        worst = off[0]
        for o in off[1:]:
            worst = worst.unionByName(o)
        left = worst.agg(F.max("x")).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        _log_unfinished(left, max_rounds)
    return cells.drop(*[f"t_{m}" for m in targets])


def _wanted(cells: DataFrame, targets: dict[str, DataFrame], margin: str, budget: float, scratch: Scratch) -> DataFrame:
    """(level, wanted, goal) of a margin in tokens: its share of the budget, and the same after levels that hold less are
    taken whole and the rest of the budget is shared by the others."""
    t = targets[margin].select(F.col("level").alias("_level"), F.col("share").cast("double").alias("share"))
    levels = cells.filter("tokens > 0").groupBy(F.col(margin).alias("level")).agg(F.sum("tokens").cast("double").alias("have"))
    levels = levels.join(t, F.col("level").eqNullSafe(F.col("_level")), "left").select("level", "have", F.coalesce("share", F.lit(0.0)).alias("share"))
    levels = scratch.write(levels, f"levels_{margin}")
    total = levels.agg(F.sum("share")).first()[0] or 1.0
    first = unit = budget / total
    while True:  # levels once whole stay whole, as the unit only grows
        whole = F.col("share") * F.lit(unit) >= F.col("have")
        taken, shares = levels.agg(F.sum(F.when(whole, F.col("have"))), F.sum(F.when(~whole, F.col("share")))).first()
        new = (budget - (taken or 0.0)) / shares if shares else unit
        if not new > unit * (1 + 1e-12):
            break
        unit = new
    return levels.select("level", (F.col("share") * F.lit(first)).alias("wanted"), F.least("have", F.col("share") * F.lit(unit)).alias("goal"))


def fit(cells: DataFrame, targets: dict[str, DataFrame], rate: float, scratch: Scratch, *, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Probabilities of cells for a sample of `rate` of all tokens, and (margin, level, wanted, expected) of every level.

    As `rake`, but in tokens and with no cell above what it holds: a level's step scales those of its cells that are
    not full, so that the level as a whole meets its goal. A small level is taken whole at most and scales down no
    other. Levels that hold less than they are wanted for give the rest of the budget to the others of their margin.
    """
    budget = rate * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {m: scratch.write(_wanted(cells, targets, m, budget, scratch), f"wanted_{m}") for m in targets}
    for m, t in wanted.items():
        t = t.select(F.col("level").alias("_level"), F.col("goal").alias(f"t_{m}"))
        cells = cells.join(t, F.col(m).eqNullSafe(F.col("_level")), "left").drop("_level").withColumn(f"t_{m}", F.coalesce(f"t_{m}", F.lit(0.0)))
    cells = scratch.write(cells.withColumn("u", F.col("tokens").cast("double")).withColumn("v", F.col("u")), "fit0")
    names, held = list(targets), F.least("u", "v")
    for i in range(0, max_rounds, ROUNDS_A_WRITE):
        step = cells
        for _ in range(ROUNDS_A_WRITE):
            for m in names:
                # A cell is full once its v is scaled by r. With the k cells of least r full, the others need
                # (goal - their u) / (sum of the others' v); the scale sought is the largest of these.
                step = step.withColumn("r", F.try_divide(F.col("u"), F.col("v")))
                open_ = step.withColumn("on", F.when(F.col("v") > 0, F.col("u")).otherwise(0.0))
                up = Window.partitionBy(m).orderBy(F.asc("r"), *[F.asc(x) for x in names]).rowsBetween(Window.unboundedPreceding, -1)
                down = Window.partitionBy(m).orderBy(F.desc("r"), *[F.desc(x) for x in names]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                scale = F.try_divide(F.col(f"t_{m}") - F.coalesce(F.sum("on").over(up), F.lit(0.0)), F.sum("v").over(down))
                all_ = Window.partitionBy(m)
                step = open_.withColumn("s", F.when(F.col("v") > 0, scale))
                step = step.withColumn("s", F.when(F.sum("on").over(all_) <= F.col(f"t_{m}"), F.max("r").over(all_)).otherwise(F.max("s").over(all_)))
                step = step.withColumn("v", F.coalesce(F.col("v") * F.greatest("s", F.lit(0.0)), F.lit(0.0))).drop("r", "on", "s")
        cells = scratch.write(step, f"fit{i + 1}")
        off = None
        for m in names:
            o = cells.groupBy(m).agg((F.abs(F.sum(held) - F.max(f"t_{m}")) / F.greatest(F.max(f"t_{m}"), F.lit(1e-300))).alias("x")).select("x")
            off = o if off is None else off.unionByName(o)
        left = off.agg(F.max("x")).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        _log_unfinished(left, max_rounds)
    report = None
    for m, t in wanted.items():
        got = cells.groupBy(F.col(m).alias("_level")).agg(F.sum(held).alias("expected"))
        one = t.join(got, F.col("level").eqNullSafe(F.col("_level")), "left").select(F.lit(m).alias("margin"), F.col("level").cast("string").alias("level"), "wanted", "expected")
        report = one if report is None else report.unionByName(one)
    return cells.select(*names, F.coalesce(F.try_divide(held, F.col("u")), F.lit(0.0)).alias("probability")), scratch.write(report, "report")


def _log_unfinished(left: float, rounds: int) -> None:
    logging.getLogger(__name__).warning("a margin is still off its target by a share of %g after %d rounds: the targets may contradict each other", left, rounds)


def _log_unmet(report: DataFrame) -> None:
    bad = report.filter(F.abs(F.col("expected") - F.col("wanted")) > UNMET * F.col("wanted"))
    n = bad.count()
    if n:
        some = bad.orderBy(F.desc(F.abs(F.col("expected") - F.col("wanted"))), "margin", "level").limit(LOGGED).collect()
        logging.getLogger(__name__).warning("%d levels cannot get the tokens wanted; the largest: %s", n, "; ".join(f"{r.margin} {r.level}: {r.expected:.0f} of {r.wanted:.0f}" for r in some))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, *, rate: float | None = None, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """`docs` (with source, lang, topic, tokens) and probability, sampled, for each row.

    With `rate`, the sample is to hold that share of all tokens; cells are taken whole at most, and levels that cannot
    get their tokens are logged (see `fit`). Without it, a document's probability is its cell's share per token over
    the largest such ratio: the largest sample that meets all targets in expectation without taking a document twice,
    which one tiny level can make very small. Sampling is by a hash of the id, so repeated rows go
    together and a null id is one key. Null levels are levels of their own; cells without tokens or without a target
    have probability 0. Only counts by cell are shuffled to fit; docs meet them again by a join that AQE can split.
    Columns named probability and sampled are replaced, all others kept whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.drop("probability", "sampled")
    cells = scratch.write(docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {m: tempered(cells, m, TEMPER[m]) for m in MARGINS}
    if rate is None:
        fitted = rake(cells, targets, scratch)
        ratio = fitted.withColumn("ratio", F.try_divide(F.col("w"), F.col("tokens").cast("double")))
        top = ratio.agg(F.max("ratio")).first()[0] or 1.0
        p = ratio.select(*MARGINS, F.coalesce(F.col("ratio") / F.lit(top), F.lit(0.0)).alias("probability"))
    else:
        p, report = fit(cells, targets, rate, scratch)
        _log_unmet(report)
    cell = "_cell"
    while cell in docs.columns:
        cell += "_"
    p = scratch.write(p.select(F.struct(*MARGINS).alias(cell), "probability"), "probability")
    same = None
    for m in MARGINS:
        c = F.col(m).eqNullSafe(F.col(f"{cell}.{m}"))
        same = c if same is None else same & c
    out = docs.join(p, same, "left").drop(cell)
    return out.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("probability"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("tokens"))
    return mix(Scratch(spark).write(rows, "tokens"), rate=RATE)
