"""Gapless numbers within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

# Cells grow as the square root of the rows: few enough to be summed, and each a small part of a group.
ROOT_PER_CELL = 8


def numbered(table: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add a long column: 0, 1, ... within each value of ``group``.

    ``table`` must be a written table, as it is read twice. Each group is dealt out by a hash of the
    ``order`` columns to cells that grow in number with the table; rows are numbered within their
    cell, and the sizes of the cells before it are added. Rows that are equal in all order columns
    may swap numbers and must therefore be interchangeable.
    """
    cells = 1 + math.isqrt(table.count()) // ROOT_PER_CELL
    dealt = table.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    out = dealt.withColumn("_row", F.row_number().over(within)).join(sizes, [group, "_cell"])
    return out.withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_cell", "_row", "_base")
