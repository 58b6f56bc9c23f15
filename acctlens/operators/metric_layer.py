"""Named dimensions and measures over the scored gold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class MetricLayer:
    """Query any dimensions and measures by name.

    Ratios are recomputed from summed parts at the requested grain, never averaged.
    """

    def __init__(self, df: DataFrame, dims: dict[str, Column], measures: dict[str, Column]):
        self.df, self.dims, self.measures = df, dims, measures

    def _rows(self, dims: list[str], measures: list[str], where: Column | None) -> DataFrame:
        unknown = [d for d in dims if d not in self.dims] + [m for m in measures if m not in self.measures]
        if unknown:
            raise KeyError(f"unknown dimension or measure: {', '.join(unknown)}")
        return self.df if where is None else self.df.where(where)

    def query_sets(
        self, sets: list[list[str]], measures: list[str], where: Column | None = None, name: str = "grouping_id"
    ) -> DataFrame:
        """Several sets of dimensions in one pass: a row for each group of each set.

        Dimensions that a set leaves out are NULL in its rows. ``name`` is a number with a bit for each of all
        dimensions, in the order in which the sets first name them, the first one's the highest: 1 where the row's set
        leaves it out, so a total differs from a group of missing values.
        """
        dims = list(dict.fromkeys(d for s in sets for d in s))
        rows = self._rows(dims, measures, where)
        # Computed beside the rows, so that measures read the columns as they were before.
        named = {f"_dim_{i}": self.dims[d] for i, d in enumerate(dims)}
        columns = {d: F.col(c) for d, c in zip(dims, named)}
        if not dims:
            return rows.agg(*[self.measures[m].alias(m) for m in measures]).withColumn(name, F.lit(0).cast("bigint"))
        grouped = rows.withColumns(named).groupingSets([[columns[d] for d in s] for s in sets], *columns.values())
        out = grouped.agg(F.grouping_id().alias(name), *[self.measures[m].alias(m) for m in measures])
        return out.withColumnsRenamed({c: d for d, c in zip(dims, named)})

    def query(
        self, dims: list[str], measures: list[str], where: Column | None = None
    ) -> DataFrame:
        rows = self._rows(dims, measures, where)
        return rows.groupBy(*[self.dims[d].alias(d) for d in dims]).agg(
            *[self.measures[m].alias(m) for m in measures]
        )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part * 100.0 / whole)


def account_metrics(df: DataFrame) -> MetricLayer:
    """11 dimensions and 20 measures of the gold table with score and category columns."""
    c = F.col
    revenue = c("annual_revenue")
    days = c("days_since_last_activity")
    dims = {
        "industry": c("industry"),
        "region": c("region"),
        "business_unit": c("business_unit"),
        "rep_name": c("rep_name"),
        "manager_name": c("manager_name"),
        "risk_category": c("risk_category"),
        "top_risk_driver_kind": F.trim(F.substring_index("top_risk_driver", "(", 1)),
        "is_stale_account": c("is_stale_account"),
        "has_escalated_cases": c("has_escalated_cases"),
        "has_backorders": c("has_backorders"),
        "revenue_band": F.when(revenue >= 500000, "large").when(revenue >= 100000, "mid").otherwise("small"),
    }
    measures = {
        "account_count": F.count(F.lit(1)),
        "total_revenue": F.sum(revenue),
        "avg_revenue": F.avg(revenue),
        "avg_risk_score": F.avg("ml_risk_score"),
        "max_risk_score": F.max("ml_risk_score"),
        "high_risk_accounts": F.count_if(c("risk_category") == "High"),
        "pct_high_risk": _ratio(F.count_if(c("risk_category") == "High"), F.count(F.lit(1))),
        "revenue_at_risk": F.sum(c("ml_risk_score") * revenue / 100.0),
        "stale_accounts": F.count_if(c("is_stale_account")),
        "avg_days_inactive": F.avg(days),
        "total_activities": F.sum("total_activities"),
        "total_contacts": F.sum("total_contacts"),
        "open_pipeline": F.sum("open_pipeline_value"),
        "closed_won": F.sum("total_closed_won"),
        "win_value_rate": _ratio(
            F.sum("total_closed_won"), F.sum(c("total_closed_won") + c("total_closed_lost"))
        ),
        "open_cases": F.sum("open_case_count"),
        "escalated_cases": F.sum("escalated_case_count"),
        "total_orders": F.sum("total_orders"),
        "order_value": F.sum("total_order_value"),
        "backorder_lines": F.sum("backorder_line_count"),
    }
    return MetricLayer(df, dims, measures)
