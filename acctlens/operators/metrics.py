"""Per-account and per-customer metrics that feed the gold table.

Inputs carry the mirror tables' own column names; outputs are snake case. Every grouping
aggregates on the map side before it shuffles, so a hot account costs one row per task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from acctlens.functions import text as tx


def total(test: Column, value: Column | int = 1) -> Column:
    """Conditional sum with 0 for the rows that fail the test, as CASE ... ELSE 0 gives."""
    return F.sum(F.when(test, value).otherwise(0))


def account_base(account: DataFrame, mapping: DataFrame, source: str) -> DataFrame:
    """Accounts of one source with their order-side key; accounts without a mapping drop out."""
    accounts = account.where(F.col("AccountSource") == source).select(
        F.col("Id").alias("sf_account_id"),
        F.col("Name").alias("account_name"),
        F.col("Industry").alias("industry"),
        F.col("AnnualRevenue").cast("double").alias("annual_revenue"),
    )
    return accounts.join(mapping.select("sf_account_id", "customer_shipto_key"), "sf_account_id")


def drop_deleted(df: DataFrame, flag: str = "IsDeleted") -> DataFrame:
    """Keep rows whose flag is false; an unknown flag drops the row too."""
    return df.where(F.col(flag) == F.lit(False))


def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def activity_metrics(task: DataFrame, as_of: date, window_days: int = 90) -> DataFrame:
    today = F.lit(as_of)
    last = F.max("ActivityDate")
    return (
        drop_deleted(task)
        .groupBy(F.col("AccountId").alias("sf_account_id"))
        .agg(
            last.alias("last_activity_date"),
            F.datediff(today, last).alias("days_since_last_activity"),
            F.count(F.lit(1)).alias("total_activities"),
            total(F.col("ActivityDate") >= F.date_sub(today, window_days)).alias("recent_activities_90d"),
        )
    )


def contact_metrics(contact: DataFrame) -> DataFrame:
    return (
        drop_deleted(contact)
        .groupBy(F.col("AccountId").alias("sf_account_id"))
        .agg(F.count(F.lit(1)).alias("total_contacts"))
    )


def opp_metrics(opportunity: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Pipeline, wins and losses, and the set of product families named in the texts.

    Grouped by (account, family) first: the set is then built from a handful of rows per account
    instead of every opportunity. A text without a family gives an empty entry unless
    ``drop_blank`` is set.
    """
    amount = F.col("Amount").cast("double")
    closed, won = F.col("IsClosed"), F.col("IsWon")
    family = F.regexp_extract(F.col("Description"), tx.FAMILY_PATTERN, 1)
    if drop_blank:
        family = F.nullif(family, F.lit(""))
    by_family = (
        drop_deleted(opportunity)
        .groupBy(F.col("AccountId").alias("sf_account_id"), family.alias("_family"))
        .agg(
            total(~closed, amount).alias("_open"),
            total(won, amount).alias("_won"),
            total(closed & ~won, amount).alias("_lost"),
            F.count_if(closed).alias("_n_closed"),
            F.count_if(won).alias("_n_won"),
        )
    )
    n_closed, n_won = F.sum("_n_closed"), F.sum("_n_won")
    rate = F.when(n_closed > 0, n_won.cast("double") * 100.0 / n_closed)
    return by_family.groupBy("sf_account_id").agg(
        F.sum("_open").alias("open_pipeline_value"),
        F.sum("_won").alias("total_closed_won"),
        F.sum("_lost").alias("total_closed_lost"),
        n_closed.alias("total_closed_opps"),
        n_won.alias("total_won_opps"),
        F.round(rate, 1).alias("win_rate_pct"),
        F.array_sort(F.collect_list("_family")).alias("opp_product_families"),
    )


def case_metrics(case: DataFrame, high: tuple[str, ...] = ("High", "Critical")) -> DataFrame:
    is_open = ~F.col("IsClosed")
    return (
        drop_deleted(case)
        .groupBy(F.col("AccountId").alias("sf_account_id"))
        .agg(
            F.count(F.lit(1)).alias("total_cases"),
            total(is_open).alias("open_case_count"),
            total(F.col("IsEscalated")).alias("escalated_case_count"),
            total(F.col("Priority").isin(*high) & is_open).alias("high_priority_open_cases"),
        )
    )


def _headers(header: DataFrame) -> DataFrame:
    return header.select("sales_order_header_key", "customer_shipto_key")


def order_metrics(header: DataFrame, line: DataFrame) -> DataFrame:
    """Distinct orders, order value, mean line value and valued lines per customer.

    Lines are summed per order before the join, so a hot order is one row per map task. The join
    leaves the rows partitioned by order, so grouping them by (customer, order) needs no shuffle
    and turns the distinct count into a plain count; repeated header rows still add their value.
    """
    value = F.col("qty_ordered") * F.col("unit_price")
    per_order = line.groupBy("sales_order_header_key").agg(
        F.sum(value).cast("double").alias("_value"), F.count(value).alias("_lines")
    )
    orders = (
        _headers(header)
        .join(per_order, "sales_order_header_key")
        .groupBy("customer_shipto_key", "sales_order_header_key")
        .agg(F.sum("_value").alias("_value"), F.sum("_lines").alias("_lines"))
    )
    order_value, lines = F.sum("_value"), F.sum("_lines")
    return orders.groupBy("customer_shipto_key").agg(
        F.count("sales_order_header_key").alias("total_orders"),
        order_value.alias("total_order_value"),
        F.when(lines > 0, order_value / lines).alias("avg_line_value"),
        lines.alias("valued_lines"),
    )


def backorder_metrics(shipment: DataFrame, status: str = "Backordered") -> DataFrame:
    back, shipped = F.sum("backorder_qty"), F.sum("total_qty")
    pct = F.when(shipped > 0, back.cast("double") * 100.0 / shipped).otherwise(F.lit(0.0))
    return shipment.groupBy("customer_shipto_key").agg(
        total(F.col("status_description") == status).alias("backorder_line_count"),
        back.cast("double").alias("total_backorder_qty"),
        shipped.cast("double").alias("total_shipped_qty"),
        F.round(pct, 1).alias("pct_qty_backordered"),
    )


def product_families(product: DataFrame) -> DataFrame:
    """Product keys with their family; the source column's odd spelling stops here."""
    return product.select("product_key", F.col("prduct_type_description").alias("family"))


def customer_families(header: DataFrame, line: DataFrame, product: DataFrame) -> DataFrame:
    """Distinct (customer, product family) pairs.

    Lines become distinct (order, product) and then distinct (order, family) pairs before they
    meet the headers, each in its own task first, so a hot order is a few rows for each task.
    """
    pairs = line.select("sales_order_header_key", "product_key").distinct()
    families = pairs.join(product_families(product), "product_key")
    return (
        _headers(header)
        .join(families.select("sales_order_header_key", "family").distinct(), "sales_order_header_key")
        .select("customer_shipto_key", "family")
        .distinct()
    )


def order_side(header: DataFrame, line: DataFrame, product: DataFrame) -> DataFrame:
    """:func:`order_metrics` and :func:`product_coverage` of every customer with orders, in one pass.

    Lines are summed per (order, product), then per (order, family), before they meet the headers.
    Families of lines without a product count as none.
    """
    value = F.col("qty_ordered") * F.col("unit_price")
    parts = line.groupBy("sales_order_header_key", "product_key").agg(
        F.sum(value).cast("double").alias("_value"), F.count(value).alias("_lines")
    )
    known = product_families(product).withColumn("_known", F.lit(1))
    parts = parts.join(known, "product_key", "left").groupBy("sales_order_header_key", "family").agg(
        F.sum("_value").alias("_value"), F.sum("_lines").alias("_lines"), F.max("_known").alias("_known"))
    # Each order by family and as a whole, in one pass; ``_whole`` is 1 for the whole. Told apart by an explode, which
    # leaves the rows of an order together, as grouping sets would not.
    kinds = F.array(F.struct("family", F.lit(0).alias("_whole")), F.struct(F.lit(None).alias("family"), F.lit(1).alias("_whole")))
    parts = _headers(header).join(parts, "sales_order_header_key").withColumn("_kind", F.explode(kinds))
    # Repeated headers add their values and count once.
    parts = parts.groupBy("sales_order_header_key", "customer_shipto_key", F.col("_kind.family"), F.col("_kind._whole")).agg(
        F.sum("_value").alias("_value"), F.sum("_lines").alias("_lines"), F.max("_known").alias("_known"))
    by_family = parts.groupBy("customer_shipto_key", "family", "_whole").agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("_value").alias("_value"), F.sum("_lines").alias("_lines"), F.max("_known").alias("_known"))
    whole = F.col("_whole") == 1
    order_value, lines = F.sum(F.when(whole, F.col("_value"))), F.sum(F.when(whole, F.col("_lines")))
    names = F.collect_list(F.when(~whole, F.col("family")))
    return by_family.groupBy("customer_shipto_key").agg(
        F.sum(F.when(whole, F.col("_orders"))).alias("total_orders"),
        order_value.alias("total_order_value"),
        F.when(lines > 0, order_value / lines).alias("avg_line_value"),
        F.when(F.max("_known") > 0, F.size(names).cast("bigint")).alias("product_families_purchased"),
        F.when(F.max("_known") > 0, F.concat_ws(", ", F.array_sort(names))).alias("product_family_list"),
    )


def coverage_summary(families: DataFrame) -> DataFrame:
    """Number and sorted list of families from distinct (customer, family) pairs."""
    return families.groupBy("customer_shipto_key").agg(
        F.count("family").alias("product_families_purchased"),
        F.concat_ws(", ", F.array_sort(F.collect_list("family"))).alias("product_family_list"),
    )


def product_coverage(header: DataFrame, line: DataFrame, product: DataFrame) -> DataFrame:
    return coverage_summary(customer_families(header, line, product))


def sales_org(customer: DataFrame, org: DataFrame) -> DataFrame:
    """Names are NULL when either part is missing."""
    def full(first: str, last: str) -> Column:
        return F.concat(F.col(first), F.lit(" "), F.col(last))

    return customer.select("customer_shipto_key", "customer_sales_org_key").join(
        org, "customer_sales_org_key"
    ).select(
        "customer_shipto_key",
        full("rp_emp_first", "rp_emp_last").alias("rep_name"),
        full("mg_emp_first", "mg_emp_last").alias("manager_name"),
        "business_unit",
        F.col("rg_code_region").alias("region"),
    )
