"""Grouped summaries, counts and checks over finished tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def summarize(
    df: DataFrame, by: list[str], aggs: dict[str, Column], order: list[Column] | None = None
) -> DataFrame:
    out = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])
    return out.orderBy(*order) if order else out


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """First k rows; ``by`` must end in a unique key to make the choice repeatable."""
    return df.orderBy(*by).limit(k)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table, counted in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def category_counts(df: DataFrame, category: str = "risk_category") -> DataFrame:
    """One row with a count per category; a category without rows shows 0."""
    return df.agg(*[
        F.count_if(F.col(category) == name).alias(name.lower()) for name in ("High", "Medium", "Low")
    ])


def cap_audit(gold: DataFrame, cap: int = 365) -> DataFrame:
    days = F.col("days_since_last_activity")
    status = F.when(days >= cap, f"{cap} (capped)").otherwise("Normal")
    return gold.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("accounts"), F.max(days).alias("max_days")
    )


def story_check(
    accounts: DataFrame,
    activities: DataFrame,
    cases: DataFrame,
    opportunities: DataFrame,
    names: list[str] | None = None,
) -> DataFrame:
    """Counts that confirm an account's story: activities, last date, cases, open ones, deals.

    Covers every account, or only the named ones.
    """
    if names is not None:
        accounts = accounts.where(F.col("account_name").isin(*names))
    acts = activities.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_activities"), F.max("activity_date").alias("last_activity_date")
    )
    tickets = cases.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("status").isin("Open", "Escalated")).alias("open_or_escalated"),
    )
    deals = opportunities.groupBy("account_id").agg(F.count(F.lit(1)).alias("total_opportunities"))
    out = accounts.select("account_id", "account_name")
    for side in (acts, tickets, deals):
        out = out.join(side, "account_id", "left")
    return out.na.fill(0, ["total_activities", "total_cases", "open_or_escalated", "total_opportunities"])


def first_match(df: DataFrame, column: str, pattern: str, key: str) -> DataFrame:
    """First row, by key, whose column contains the text; NULL never matches."""
    return df.where(F.col(column).contains(pattern)).orderBy(key).limit(1)


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key in one pass, for rows with few versions of a key (deltas of a mirror, a batch).

    Each task keeps one row per key before the shuffle, but sorts its whole rows for that.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_by_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Newest row per key, of one or several columns, by the order columns; NULL is the oldest.

    Rows that tie in all order columns are decided by the larger hash of their other columns (maps left
    out), and of equal rows one stays.

    The greatest value of each order column is found in turn, by a hash aggregate over keys and order
    columns alone; whole rows are then fetched by a semi join on keys and greatest values. So the sort and
    the shuffle of an aggregate over whole rows fall away, and a key with very many versions is spread by its
    order values. ``df`` is read once for each order column and twice more; it must give the same rows each time.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [f.name for f in df.schema if f.name not in [*keys, *order] and "map<" not in f.dataType.simpleString()]
    # Names for the greatest values that no column of the rows has.
    mark = "_"
    while any(c.startswith(f"{mark}top") for c in df.columns):
        mark += "_"
    steps = [F.col(c) for c in keys + list(order)] + ([F.xxhash64(*rest)] if rest else [])
    names = [f"{mark}top{i}" for i in range(len(steps))]

    def reaching(best: DataFrame, done: int) -> DataFrame:
        """The rows that have a key's greatest values in all that is decided."""
        same = [step.eqNullSafe(F.col(name)) for step, name in zip(steps[:done], names)]
        return df.join(best, reduce(and_, same), "left_semi")

    rows, best = df, None
    for done in range(len(keys), len(steps)):
        # The values before are the same in all rows of a key by now, and come along as grouping columns.
        groups = [step.alias(name) for step, name in zip(steps[:done], names)]
        best = rows.groupBy(*groups).agg(F.max(steps[done]).alias(names[done]))
        rows = reaching(best, done + 1)
    maps = len(keys) + len(order) + len(rest) < len(df.columns)
    return rows.dropDuplicates(keys) if maps else rows.distinct()
