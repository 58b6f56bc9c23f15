"""Comparisons of an account with its group and with the whole portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acctlens.operators.joins import lookup_join


def peer_benchmark(df: DataFrame, score: str, group: str = "industry") -> DataFrame:
    """Adds the group's mean score and the distance to it.

    The mean is an aggregate joined back, not a window: a window would sort a whole group,
    possibly a third of all accounts, in one task.
    """
    stats = df.groupBy(group).agg(F.avg(score).alias("industry_avg_risk"), F.count(F.lit(1)).alias("_n"))
    out = lookup_join(
        df, stats.drop("_n"), group, counts=stats.select(group, "_n"), null_safe=True
    )
    return out.withColumn("risk_vs_industry", F.round(F.col(score) - F.col("industry_avg_risk"), 1))


def _bought(customers: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every customer with the array of families it bought, empty where it bought none."""
    bought = coverage.where(F.col("family").isNotNull()).groupBy("customer_shipto_key").agg(
        F.collect_list("family").alias("_bought")
    )
    every = customers.where(F.col("customer_shipto_key").isNotNull()).select("customer_shipto_key").distinct()
    return every.join(bought, "customer_shipto_key", "left").withColumn(
        "_bought", F.coalesce("_bought", F.array().cast("array<string>"))
    )


def whitespace_families(customers: DataFrame, coverage: DataFrame, families: DataFrame) -> DataFrame:
    """Per customer the sorted array of the families it has not bought.

    ``coverage`` holds distinct (customer, family) pairs, ``families`` the families of the product
    dimension, a code list whose distinct names fit one row. Customers without a purchase lack the
    whole range. No pairs of customers and families are formed.
    """
    every = families.where(F.col("family").isNotNull()).agg(F.array_sort(F.collect_set("family")))
    gaps = F.array_except(every.scalar(), F.col("_bought"))
    return _bought(customers, coverage).select("customer_shipto_key", gaps.alias("families"))


def whitespace_score(customers: DataFrame, coverage: DataFrame, families: DataFrame) -> DataFrame:
    """Families bought per customer against the mean of all customers and the whole range."""
    counts = _bought(customers, coverage).select(
        "customer_shipto_key", F.size("_bought").cast("long").alias("families_bought")
    )
    mean = counts.agg(F.avg("families_bought")).scalar()
    size = families.agg(F.count_distinct("family")).scalar()
    return counts.select(
        "customer_shipto_key",
        "families_bought",
        F.round(mean, 2).alias("portfolio_avg_families"),
        F.round(F.col("families_bought") - mean, 2).alias("families_vs_portfolio"),
        (size - F.col("families_bought")).alias("families_missing"),
    )
