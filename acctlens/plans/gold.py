"""The gold table: one row per account with all metrics, flags and the composite risk score."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from acctlens.functions import risk
from acctlens.operators import metrics as m
from acctlens.operators.joins import left_join_on_spread, spread_null_key
from acctlens.operators.quality import assert_unique
from acctlens.sources.tables import Catalog, write_clustered

# Columns that show 0 where an account has no rows in the source.
ZERO_DEFAULTS = [
    "total_activities", "recent_activities_90d", "total_contacts", "open_pipeline_value",
    "total_closed_won", "total_closed_lost", "total_cases", "open_case_count",
    "escalated_case_count", "high_priority_open_cases", "total_orders", "total_order_value",
    "backorder_line_count", "total_backorder_qty", "pct_qty_backordered",
    "product_families_purchased",
]

COLUMNS = [
    "sf_account_id", "account_name", "industry", "annual_revenue", "customer_shipto_key",
    "rep_name", "manager_name", "business_unit", "region",
    "last_activity_date", "days_since_last_activity", "total_activities", "recent_activities_90d",
    "total_contacts", "open_pipeline_value", "total_closed_won", "total_closed_lost",
    "win_rate_pct", "opp_product_families", "total_cases", "open_case_count",
    "escalated_case_count", "high_priority_open_cases", "total_orders", "total_order_value",
    "avg_line_value", "backorder_line_count", "total_backorder_qty", "pct_qty_backordered",
    "product_families_purchased", "product_family_list", "is_stale_account",
    "has_escalated_cases", "has_backorders", "risk_score_raw",
]


def default_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """0 for NULL; a value that is not a number stays."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def risk_flags(df: DataFrame, stale_days: int = 90) -> DataFrame:
    """Stale, escalated and backordered flags; never NULL."""
    def flag(test):
        return F.coalesce(test, F.lit(False))

    return df.withColumns({
        "is_stale_account": flag(F.col("days_since_last_activity") > stale_days),
        "has_escalated_cases": flag(F.col("escalated_case_count") > 0),
        "has_backorders": flag(F.col("backorder_line_count") > 0),
    })


def with_risk_score(df: DataFrame, floor: bool = False) -> DataFrame:
    return df.withColumn("risk_score_raw", risk.risk_score_raw(
        F.col("days_since_last_activity"), F.col("escalated_case_count"),
        F.col("pct_qty_backordered"), F.col("high_priority_open_cases"), floor,
    ))


def build_c360(
    inputs: dict[str, DataFrame], as_of: date, source: str, window_days: int = 90
) -> DataFrame:
    """Star of left joins from the account base to seven pre-aggregated sides.

    The three order-side joins come first, on the order-side key, then the four customer-system
    joins on the account id: the base is shuffled once per key. Accounts without an order-side
    key are spread over the partitions. Write the result once and let later queries read it.
    """
    header, line = inputs["cur_sales_order_header"], inputs["cur_sales_order_line"]
    base = m.account_base(inputs["sf_account"], inputs["sf_cdm_key_mapping"], source)
    base = spread_null_key(base, "customer_shipto_key", "sf_account_id", "_spread")
    for side in (
        m.sales_org(inputs["cur_customer_shipto"], inputs["cur_customer_sales_org"]),
        m.order_side(header, line, inputs["cur_product"]),
        m.backorder_metrics(inputs["cur_shipment_line"]).drop("total_shipped_qty"),
    ):
        base = left_join_on_spread(base, side, "customer_shipto_key", "_spread")
    for side in (
        m.activity_metrics(inputs["sf_task"], as_of, window_days),
        m.contact_metrics(inputs["sf_contact"]),
        m.opp_metrics(inputs["sf_opportunity"]).drop("total_closed_opps", "total_won_opps"),
        m.case_metrics(inputs["sf_case"]),
    ):
        base = base.join(side, "sf_account_id", "left")
    clamped = base.withColumn(
        "days_since_last_activity", risk.clamp_days(F.col("days_since_last_activity"))
    )
    return with_risk_score(risk_flags(default_zero(clamped, ZERO_DEFAULTS))).select(*COLUMNS)


def refresh_gold(
    inputs: dict[str, DataFrame], as_of: date, source: str, cat: Catalog,
    name: str = "customer_360", window_days: int = 90,
) -> None:
    """Rebuild the gold table, laid out by (industry, region).

    Raises if the mapping or a dimension has a key twice, which would repeat accounts.
    """
    assert_unique(inputs["sf_cdm_key_mapping"], "sf_account_id")
    assert_unique(inputs["cur_customer_shipto"], "customer_shipto_key")
    assert_unique(inputs["cur_customer_sales_org"], "customer_sales_org_key")
    gold = build_c360(inputs, as_of, source, window_days)
    write_clustered(gold, cat, name, ["industry", "region"], "sf_account_id")
