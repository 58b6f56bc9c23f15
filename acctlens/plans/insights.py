"""Signals beyond the basic score: trend, peers, value at risk, delivery, product gaps."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from acctlens.functions import risk
from acctlens.operators import metrics as m
from acctlens.operators.joins import left_join_on_spread, spread_null_key
from acctlens.operators.peers import peer_benchmark, whitespace_score


def revenue_trend(orders: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Change of the last ``days`` days' revenue against the ``days`` before, in percent.

    Both ranges include their first day and exclude their end. NULL when the earlier one is zero.
    Only orders of the two ranges are read; ``orders`` has customer_shipto_key, order_date and
    order_value.
    """
    def bound(day: date) -> Column:
        return F.lit(day.isoformat()).cast(orders.schema["order_date"].dataType)

    middle = bound(as_of - timedelta(days=days))
    day = F.col("order_date")
    window = orders.where((day >= bound(as_of - timedelta(days=2 * days))) & (day < bound(as_of)))
    sums = window.groupBy("customer_shipto_key").agg(
        m.total(day >= middle, F.col("order_value")).cast("double").alias("recent_revenue"),
        m.total(day < middle, F.col("order_value")).cast("double").alias("prior_revenue"),
    )
    change = F.col("recent_revenue") - F.col("prior_revenue")
    return sums.withColumn(
        "rev_trend_pct",
        F.when(F.col("prior_revenue") != 0, F.round(change * 100.0 / F.col("prior_revenue"), 1)),
    )


def delivery_reliability(
    lines: DataFrame, promised: Column | None = None, actual: Column | None = None
) -> DataFrame:
    """Share of lines shipped after their promise date, and the mean delay of those lines."""
    promised = F.col("promised_date") if promised is None else promised
    actual = F.col("actual_date") if actual is None else actual
    late = actual > promised
    return lines.groupBy("customer_shipto_key").agg(
        F.round(F.avg(F.when(late, 100.0).when(~late, 0.0)), 1).alias("pct_delivery_pushed"),
        F.round(F.avg(F.when(late, F.datediff(actual, promised))), 1).alias("avg_days_pushed"),
    )


def deep_insights(inputs: dict[str, DataFrame], as_of: date, days: int = 90) -> DataFrame:
    """All signals on one row per account.

    ``inputs``: ``scored`` (gold with ml_risk_score) and ``customer_families`` (distinct customer
    and family pairs), both read twice, so pass written tables; ``order_revenue``,
    ``cur_shipment_line``, ``cur_product`` and ``cur_customer_shipto``.
    """
    scored = inputs["scored"].select(
        "sf_account_id", "customer_shipto_key", "industry", "annual_revenue", "ml_risk_score"
    )
    base = peer_benchmark(scored, "ml_risk_score")
    base = base.withColumn(
        "revenue_at_risk",
        F.round(risk.revenue_at_risk(F.col("ml_risk_score"), F.col("annual_revenue")), 2),
    )
    base = spread_null_key(base, "customer_shipto_key", "sf_account_id", "_spread")
    families = m.product_families(inputs["cur_product"])
    for side in (
        revenue_trend(inputs["order_revenue"], as_of, days),
        delivery_reliability(inputs["cur_shipment_line"]),
        whitespace_score(inputs["cur_customer_shipto"], inputs["customer_families"], families),
    ):
        base = left_join_on_spread(base, side, "customer_shipto_key", "_spread")
    return base.select(
        "sf_account_id", "industry", "rev_trend_pct",
        F.round("industry_avg_risk", 4).alias("industry_avg_risk"), "risk_vs_industry",
        "revenue_at_risk", "pct_delivery_pushed", "avg_days_pushed", "families_bought",
        "portfolio_avg_families", "families_vs_portfolio", "families_missing",
    )
