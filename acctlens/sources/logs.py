"""Log text: keyword lines, trimmed and cut for reading."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from acctlens.functions import text as tx

# Keywords of the callout log check (fixed values).
KEYWORDS = ["USER_DEBUG", "CALLOUT", "EXCEPTION", "FATAL"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``; files are split across tasks."""
    return spark.read.text(path)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text column as (key, line_no, value)."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "value"))


def scan_log(lines: DataFrame, keywords: list[str] = KEYWORDS, width: int = 300) -> DataFrame:
    """Lines holding any keyword (case-sensitive), stripped, first ``width`` characters."""
    hit = reduce(or_, [F.col("value").contains(k) for k in keywords])
    return lines.where(hit).withColumn("value", tx.left(tx.strip(F.col("value")), width))
