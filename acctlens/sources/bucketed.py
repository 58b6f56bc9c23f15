"""Mirrors and order facts as tables bucketed by the key that they are grouped or joined by.

Rows of one key lie in one bucket file, written once. Grouping a child object by account, shipments by
customer, lines by order, and joining lines to headers then need no shuffle of facts; what is left to shuffle is one
row for each order or customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acctlens.sources.tables import Catalog

# Rows of the largest fact in a bucket.
BUCKET_ROWS = 250_000
ORDER = "sales_order_header_key"
KEYS = {
    "sf_task": "AccountId", "sf_contact": "AccountId", "sf_opportunity": "AccountId", "sf_case": "AccountId",
    "cur_sales_order_header": ORDER, "cur_sales_order_line": ORDER, "cur_shipment_line": "customer_shipto_key",
}


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Replace a table of the session's catalog. Rows are dealt out by the key first, so a bucket is one file
    and not one for each task."""
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def bucket_count(inputs: dict[str, DataFrame], rows: int = BUCKET_ROWS) -> int:
    """Buckets of at most about ``rows`` rows of the largest fact. Counts the facts."""
    return max(1, *(-(-inputs[name].count() // rows) for name in KEYS))


def co_partition(inputs: dict[str, DataFrame], cat: Catalog, buckets: int | None = None, prefix: str = "") -> dict[str, DataFrame]:
    """The inputs of the gold table with all facts as bucketed tables; dimensions and the account side stay.

    ``buckets`` is the same for all, so that their buckets meet. If it is not given it follows the largest fact
    (:func:`bucket_count`), as one task reads, sorts and groups a bucket.
    """
    buckets = bucket_count(inputs) if buckets is None else buckets
    out = dict(inputs)
    for name, key in KEYS.items():
        table = cat.table(prefix + name)
        write_bucketed(inputs[name], table, key, buckets)
        out[name] = inputs[name].sparkSession.table(table)
    return out


def drop_bucketed(spark: SparkSession, cat: Catalog, prefix: str = "") -> None:
    for name in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS {cat.table(prefix + name)}")
