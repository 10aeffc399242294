"""The decayed ranking score and other scalar rules of memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-lives by category in days (fixed values); other categories have 30.
HALF_LIVES = {"emotion": 1, "humor": 3, "dynamic": 7, "pattern": 14, "insight": 30, "fact": 60, "preference": 90, "decision": 120, "trust": 180, "correction": 365, "milestone": 730}
DEFAULT_HALF_LIFE, IMMORTAL_DAYS, FLOOR_DAYS = 30, 99_999, 180
SEMANTIC_FLOOR = 0.80


def half_life(category: Column) -> Column:
    out = None
    for k, v in HALF_LIVES.items():
        out = F.when(category == k, v) if out is None else out.when(category == k, v)
    return out.otherwise(DEFAULT_HALF_LIFE).cast("double")


def days_old(created_at: Column, as_of: Column) -> Column:
    """Days between two times, not below 0; an unknown time counts as now."""
    d = (F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.greatest(F.lit(0.0), d), F.lit(0.0))


def effective_half_life(category: Column, importance: Column, valence: Column, arousal: Column) -> Column:
    base = half_life(category)
    hl = F.when(importance >= 10, float(IMMORTAL_DAYS)).when(importance >= 8, F.greatest(base * 2, F.lit(float(FLOOR_DAYS)))).otherwise(base)
    feeling = F.greatest(F.abs(F.coalesce(valence, F.lit(0.0))), F.coalesce(arousal, F.lit(0.0)))
    return F.when(feeling > 0.5, hl * (1 + F.least(feeling, F.lit(1.0)))).otherwise(hl)


def decay_score(similarity: Column, category: Column, importance: Column, valence: Column, arousal: Column, utility: Column, confidence: Column, days: Column) -> Column:
    decay = F.pow(F.lit(0.5), days / effective_half_life(category, importance, valence, arousal))
    sure = F.least(F.greatest(F.coalesce(confidence, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    blended = similarity * 0.5 + F.coalesce(utility, F.lit(0.5)) * 0.3 + sure * 0.2
    return blended * decay * (F.lit(0.5) + importance / F.lit(20.0))


def ranked_score(score: Column, similarity: Column, importance: Column, floor: float = SEMANTIC_FLOOR) -> Column:
    """The score, but not below the share `floor` of the similarity, plus a tie-break by importance."""
    return F.greatest(score, F.greatest(similarity, F.lit(0.0)) * floor) + importance * 1e-6


def grown_confidence(confidence: Column, activations: Column | int = 1) -> Column:
    """Confidence after activations that each close a tenth of the gap to 1 (closed form, rounded once)."""
    n = activations if isinstance(activations, Column) else F.lit(activations)
    return F.round(F.least(F.lit(1.0), 1 - (1 - confidence) * F.pow(F.lit(0.9), n)), 4)


def success_rate(success: Column, fail: Column) -> Column:
    return F.coalesce(F.try_divide(success.cast("double"), success + fail), F.lit(0.0))
