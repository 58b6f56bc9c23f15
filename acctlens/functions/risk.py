"""Risk rules as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def clamp_days(days: Column, cap: int = 365) -> Column:
    """Days since the last activity; a missing value counts as the cap."""
    return F.least(F.lit(cap), F.coalesce(days, F.lit(cap)))


def risk_score_raw(
    days: Column, escalated: Column, pct_back: Column, hi_open: Column, floor: bool = False
) -> Column:
    """Composite score: staleness 0-40, escalations 0-25, backorders 0-25, urgent open cases 0-10.

    The factors are exact decimals, so whole-number inputs never pick up binary noise before the
    rounding. A future activity date gives negative days and so a negative part; ``floor`` cuts
    the score at zero.
    """
    zero = F.lit(0)
    staleness = F.least(F.lit(40), days * F.lit(Decimal("0.2")))
    escalations = F.least(F.lit(25), F.coalesce(escalated, zero) * F.lit(Decimal("12.5")))
    backorders = F.least(F.lit(25), F.coalesce(pct_back, zero) * F.lit(Decimal("1.5")))
    urgent = F.least(F.lit(10), F.coalesce(hi_open, zero) * F.lit(5))
    score = F.least(F.lit(100), F.round(staleness + escalations + backorders + urgent))
    if floor:
        score = F.greatest(F.lit(0), score)
    return score.cast("double")


def risk_category(score: Column, high: float = 55, medium: float = 25) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def top_risk_driver(days: Column, pct: Column, cases: Column, pipeline: Column) -> Column:
    """First matching reason; the percentage is rounded half-even like the published text."""

    def text(value: Column) -> Column:
        return value.cast("bigint").cast("string")

    return (
        F.when(days > 90, F.concat(F.lit("Inactivity ("), text(days), F.lit(" days)")))
        .when(pct > 15, F.concat(F.lit("Backorder Exposure ("), text(F.bround(pct, 0)), F.lit("%)")))
        .when(cases > 3, F.concat(F.lit("Open Cases ("), text(cases), F.lit(")")))
        .when(pipeline == 0, F.lit("No Active Pipeline"))
        .otherwise(F.lit("Healthy"))
    )


def revenue_at_risk(score: Column, revenue: Column) -> Column:
    """Annual revenue weighted by the score read as a percentage."""
    return score * revenue / 100.0
