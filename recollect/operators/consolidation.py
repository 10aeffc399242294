"""Consolidation of memories in four phases, and routing of new ones by surprise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .blocks import BROADCAST_ROWS
from .components import connected_components
from .memory import live
from .vectors import cosine, norm, similar_pairs

REPLAY_BOOST, FORGET_DECAY, STALE_DAYS, PRUNE_BELOW, MERGE_AT, MAX_PRUNE = 0.10, 0.85, 14, 0.05, 0.92, 50


def _or_default(c: str, default: float) -> Column:
    """Null and 0 both stand for the default (as the stored values are read)."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), default).otherwise(F.col(c))


def replay(df: DataFrame, as_of: Column, boost: float = REPLAY_BOOST) -> DataFrame:
    """Live rows activated in the last 24 hours gain relevance, up to 1; `affected` marks them."""
    hit = F.col("invalid_at").isNull() & F.coalesce(F.col("last_activation") > as_of - F.expr("INTERVAL 24 HOURS"), F.lit(False))
    return df.withColumn("affected", hit).withColumn("relevance_score", F.when(hit, F.least(F.lit(1.0), _or_default("relevance_score", 1.0) + boost)).otherwise(F.col("relevance_score")))


def forget(df: DataFrame, as_of: Column, decay: float = FORGET_DECAY, stale_days: int = STALE_DAYS) -> DataFrame:
    """Live rows of importance 7 at most and not activated for `stale_days` fade; feelings resist."""
    stale = F.col("last_activation").isNull() | (F.col("last_activation") < as_of - F.make_dt_interval(F.lit(stale_days)))
    hit = F.col("invalid_at").isNull() & (F.col("importance") <= 7) & stale
    resist = 1 + 0.5 * F.abs(F.coalesce("valence", F.lit(0.0))) + 0.3 * F.coalesce("arousal", F.lit(0.0))
    keep = 1 - (1 - decay) / resist
    df = df.withColumn("affected", hit).withColumn("relevance_score", F.when(hit, _or_default("relevance_score", 1.0) * keep).otherwise(F.col("relevance_score")))
    return df.withColumn("utility_score", F.when(hit, F.greatest(F.lit(0.0), _or_default("utility_score", 0.5) - 0.03)).otherwise(F.col("utility_score")))


def prune(df: DataFrame, as_of: Column, below: float = PRUNE_BELOW, most: int = MAX_PRUNE) -> DataFrame:
    """Of each agent at most `most` rows of the lowest relevance under `below` are invalidated.

    Only rows that may go are ranked, with a limit by agent before the exchange; at most `most` ids an agent meet the
    rows again, broadcast if they are few.
    """
    can = F.col("invalid_at").isNull() & (F.col("relevance_score") < below) & (F.col("importance") <= 5) & ~F.coalesce(F.col("identity_defining"), F.lit(False))
    w = Window.partitionBy("agent").orderBy("relevance_score", "id")
    gone = df.filter(can).select("agent", "id", "relevance_score").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    gone = Scratch(df.sparkSession).write(gone.select(F.col("id").alias("_gone")), "pruned")
    few = gone.count() <= BROADCAST_ROWS
    df = df.join(F.broadcast(gone) if few else gone, df["id"] == F.col("_gone"), "left").withColumn("affected", F.col("_gone").isNotNull()).drop("_gone")
    return df.withColumn("invalid_at", F.when(F.col("affected"), as_of).otherwise(F.col("invalid_at")))


def merge_pairs(df: DataFrame, threshold: float = MERGE_AT) -> DataFrame:
    return similar_pairs(live(df).select("agent", "id", "vec"), threshold)


def merge_decisions(df: DataFrame, pairs: DataFrame, *, compat: bool = True) -> DataFrame:
    """(agent, id, invalidated, relevance_score, merges) of every memory that a merge touches.

    Pairs are replayed by (a, b): the more important, then more relevant, then earlier row survives with relevance
    +0.05 of what it had at the start; victims take no further part as b. With `compat` a row that has lost still
    judges its later pairs, as the sequential loop does; without, it stops. Only pairs of one connected group depend on
    each other, so each group is replayed by itself, whatever the size of its agent.
    """
    scratch = Scratch(df.sparkSession)
    pairs = scratch.write(pairs.select("agent", "a", "b"), "pairs")
    groups = connected_components(pairs, scratch).select(F.col("node").alias("id_a"), F.col("root").alias("_group"))
    side = live(df).select("agent", "id", "importance", _or_default("relevance_score", 1.0).alias("rel"))
    a = side.select("agent", *[F.col(c).alias(f"{c}_a") for c in ("id", "importance", "rel")])
    b = side.select("agent", *[F.col(c).alias(f"{c}_b") for c in ("id", "importance", "rel")])
    p = pairs.select("agent", F.col("a").alias("id_a"), F.col("b").alias("id_b")).join(groups, "id_a").join(a, ["agent", "id_a"]).join(b, ["agent", "id_b"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lost: set[int] = set()
        out: dict[int, list] = {}
        for id_a, own in pdf.sort_values(["id_a", "id_b"]).groupby("id_a", sort=True):
            if id_a in lost:
                continue
            for r in own.itertuples(index=False):
                if r.id_b in lost:
                    continue
                better_b = (r.importance_b, r.rel_b) > (r.importance_a, r.rel_a)
                win, rel, lose = (r.id_b, r.rel_b, r.id_a) if better_b else (r.id_a, r.rel_a, r.id_b)
                out.setdefault(win, [False, None, 0])
                out[win][1] = min(1.0, rel + 0.05)
                out[win][2] += 1
                out.setdefault(lose, [False, None, 0])[0] = True
                lost.add(lose)
                if better_b and not compat:
                    break
        return pd.DataFrame([(pdf["agent"].iloc[0], int(i), v[0], v[1], v[2]) for i, v in out.items()], columns=["agent", "id", "invalidated", "relevance_score", "merges"])

    return p.groupBy("agent", "_group").applyInPandas(run, "agent string, id long, invalidated boolean, relevance_score double, merges long")


def consolidate(df: DataFrame, as_of: Column, threshold: float = MERGE_AT, *, compat: bool = True) -> DataFrame:
    """Near-duplicates merged: victims invalidated, survivors more relevant; `affected` counts a row's victories."""
    d = merge_decisions(df, merge_pairs(df, threshold), compat=compat).withColumnRenamed("relevance_score", "_rel")
    out = df.join(d, ["agent", "id"], "left")
    out = out.withColumn("invalid_at", F.when(F.col("invalidated"), as_of).otherwise(F.col("invalid_at")))
    return out.withColumn("relevance_score", F.coalesce("_rel", "relevance_score")).withColumn("affected", F.coalesce("merges", F.lit(0))).drop("_rel", "invalidated", "merges")


def run_phases(df: DataFrame, as_of: Column, *, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(memories after the phases, report): live, each phase sees what the one before wrote; dry, all see the input.

    What a phase gives is written before it is counted and passed on, so no phase runs twice.
    """
    steps = {"replay": replay, "forget": forget, "prune": prune, "consolidate": consolidate}
    cur, report, scratch = df, None, Scratch(df.sparkSession)
    for name, f in steps.items():
        out = f(df if dry_run else cur, as_of)
        out = scratch.write(out.select("agent", "affected") if dry_run else out, name)
        n = out.groupBy("agent").agg(F.sum(F.col("affected").cast("long")).alias("affected")).select("agent", F.lit(name).alias("phase"), "affected")
        report = n if report is None else report.unionByName(n)
        cur = cur if dry_run else out.drop("affected")
    return cur, report


SURPRISE, UTILITY, LOOKBACK = 0.3, 0.6, 50


def newest(history: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """The newest live rows of each agent, all that `route` looks at: a caller that embeds them embeds no others."""
    w = Window.partitionBy("agent").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return live(history).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= lookback).drop("_r")


def route(candidates: DataFrame, history: DataFrame, *, surprise: float = 0, utility: float = 0, lookback: int = LOOKBACK) -> DataFrame:
    """Routes candidates (agent, cand_id, vec, utility) by what the agent's `lookback` newest memories already hold.

    surprise = 1 - the largest cosine (not below 0), rpe = surprise * utility; fast_path if both are under their
    thresholds (0 stands for the default), full_processing otherwise and without a history. The history of an agent
    is cut before the join, so a candidate meets at most `lookback` rows.
    """
    s, u = surprise or SURPRISE, utility or UTILITY
    past = newest(history, lookback).filter(F.col("vec").isNotNull()).select("agent", F.col("vec").alias("_v"), norm(F.col("vec")).alias("_vn"))
    candidates = candidates.withColumn("_cn", norm(F.col("vec")))
    sim = candidates.join(past, "agent", "left").groupBy("agent", "cand_id", "utility").agg(F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(F.col("_v").isNotNull(), cosine(F.col("vec"), F.col("_v"), F.col("_cn"), F.col("_vn"))))), F.lit(0.0)).alias("max_similarity"))
    out = sim.withColumn("surprise", 1 - F.col("max_similarity")).withColumn("rpe", F.col("surprise") * F.col("utility"))
    fast = (F.col("surprise") < s) & (F.col("utility") < u)
    why = F.array_join(F.filter(F.array(F.when(F.col("surprise") >= s, F.format_string(f"high surprise (%.3f>={s})", "surprise")), F.when(F.col("utility") >= u, F.format_string(f"high utility (%.3f>={u})", "utility"))), lambda x: x.isNotNull()), " and ")
    low = F.format_string(f"low surprise (%.3f<{s}) and low utility (%.3f<{u})", "surprise", "utility")
    return out.withColumn("route", F.when(fast, "fast_path").otherwise("full_processing")).withColumn("reason", F.when(fast, low).otherwise(why))


def report_summary(report: DataFrame, *, dry_run: bool = True) -> DataFrame:
    """(agent, summary): the report of run_phases as text, phases in their order and the total."""
    order = F.array_position(F.array(*[F.lit(p) for p in ("replay", "forget", "prune", "consolidate")]), F.col("phase"))
    line = F.concat(F.lit("  "), F.upper("phase"), F.lit(": "), F.col("affected").cast("string"), F.lit(" affected"))
    per = report.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("rows"), F.sum("affected").alias("total"))
    head = F.concat(F.lit(f"Sleep Gate [{'DRY-RUN' if dry_run else 'LIVE'}] — "), "agent")
    return per.select("agent", F.concat_ws("\n", head, F.transform("rows", lambda x: x["line"]), F.concat(F.lit("  Total: "), F.col("total").cast("string"))).alias("summary"))
