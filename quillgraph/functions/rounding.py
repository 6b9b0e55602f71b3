"""Four-decimal rounding, half to even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(x: Column) -> Column:
    """``format_number`` renders the exact value of the double and rounds half to even, as Python's round does.

    It drops a half in the very first place, so values under 0.0001 are decided
    here; the double next to 0.00005 lies above it.
    """
    tiny = F.when(F.abs(x) >= 0.00005, F.signum(x) * 0.0001).otherwise(F.lit(0.0))
    return F.when(F.abs(x) < 0.0001, tiny).otherwise(F.regexp_replace(F.format_number(x, 4), ",", "").cast("double"))


def clamp_weight(x: Column) -> Column:
    """Into [0, 1], four decimals; what is not a finite number counts as 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).otherwise(F.lit(0.0))


def effective_importance(feedback: Column, centrality: Column) -> Column:
    """Mean of both weights."""
    return round4((clamp_weight(feedback) + clamp_weight(centrality)) / 2)


def feedback_value(score: Column) -> Column:
    """-1, 0, 1 as 0, 0.5, 1."""
    return F.when(score == -1, 0.0).when(score == 0, 0.5).when(score == 1, 1.0)


def updated_weight(weight: Column, value: Column, alpha: float = 0.1) -> Column:
    """One step of the streaming weight."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return round4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight + F.lit(alpha) * (value - weight))))
