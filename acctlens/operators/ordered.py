"""One ordered pass over a table: running maxima, ranges merged, points looked up in ranges.

The table is dealt out by ranges of the order and sorted there; every range passes its own maximum on to
those behind it, one row each. So the pass is a sort and a sum of small rows, no range join, and no task
holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from acctlens.sources.tables import settle


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    while stem in df.columns:
        stem += "_"
    return stem


def running_max(df: DataFrame, order: list[str], value: str, name: str, itself: bool = True) -> DataFrame:
    """Add the largest ``value`` of all rows before each row in the order, and of the row if ``itself``.

    NULL values are passed over. Rows that are equal in the order columns may come in any order among
    them. The order columns should tell most rows apart, as equal rows share a range.
    """
    at, part, carried = (unused(df, c) for c in ("_at", "_range", "_carried"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    # The number's upper bits are the range. Written, so that a task that runs again deals nothing out anew.
    ranged = settle(ranged.withColumn(part, F.shiftright(at, 33)), "ranged")
    last = Window.currentRow if itself else -1
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, last)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, and there are no more ranges than shuffle partitions.
    ends = ranged.groupBy(part).agg(F.max(value).alias(carried)).select(part, F.max(carried).over(before).alias(carried))
    out = ranged.withColumn(name, F.max(value).over(within)).join(F.broadcast(ends), part)
    return out.withColumn(name, F.greatest(name, carried)).drop(at, part, carried)


def merged_ranges(ranges: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Disjoint ranges (first, last) that cover the same points: those that overlap become one.

    Both ends belong to a range. Ranges with a NULL end, or that end before they start, cover nothing.
    """
    whole = ranges.select(F.col(first).alias("first"), F.col(last).alias("last")).where("first <= last").distinct()
    seen = running_max(whole, ["first", "last"], "last", "reach", itself=False)
    opened = seen.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), F.col("first")))
    grouped = running_max(opened, ["first", "last"], "opens", "start")
    return grouped.groupBy(F.col("start").alias("first")).agg(F.max("last").alias("last"))


def in_ranges(points: DataFrame, point: str, ranges: DataFrame, name: str, first: str = "first", last: str = "last") -> DataFrame:
    """Add whether a point lies in any of the ranges, both ends included; they may overlap.

    Points and starts of ranges pass by in order, and the farthest end so far decides: a range that
    starts at or before a point and ends at or behind it covers it. ``points`` should be distinct. A NULL point lies
    in none.
    """
    row, at, end = (unused(points, c) for c in ("_row", "_point", "_end"))
    starts = ranges.where(F.col(first) <= F.col(last)).groupBy(F.col(first).alias(at)).agg(F.max(last).alias(end))
    rows = points.where(F.col(point).isNotNull()).select(F.struct("*").alias(row), F.col(point).alias(at), F.lit(None).cast(starts.schema[end].dataType).alias(end))
    # At one point, the start of a range comes first.
    both = starts.select(F.lit(None).cast(rows.schema[row].dataType).alias(row), at, end, F.lit(0).alias("kind"))
    both = both.unionByName(rows.withColumn("kind", F.lit(1)))
    reached = running_max(both, [at, "kind"], end, "reach").where(F.col(row).isNotNull())
    found = reached.select(f"{row}.*", F.coalesce(F.col("reach") >= F.col(at), F.lit(False)).alias(name))
    return found.unionByName(points.where(F.col(point).isNull()).withColumn(name, F.lit(False)))
