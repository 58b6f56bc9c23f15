"""Sums and counted values per key that follow added and retracted rows, without reading the facts again.

A state is a log-structured mirror with one row per key: the sums of the measures over all rows of the key, and the
number of those rows. A change set adds the rows that came and subtracts the rows that went, so its
cost is that of the changed rows and of the states of the keys they touch. Sums are exact decimals: what is added and
taken away again leaves nothing behind.

Sets, minima and maxima come from counted values: a state whose key has the value as a second column. A
value is in the set while its count is not zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from acctlens.sources.tables import settle
from acctlens.streaming.mirror import Mirror

EXACT = "decimal(38,9)"
# A change set: the rows as they were, and as they are now; either may be missing.
Changes = tuple[DataFrame | None, DataFrame | None]


def signed(changes: Changes, *measures: str) -> DataFrame | None:
    """The rows of a change set with their sign in ``_rows`` and their measures as exact numbers of that sign."""
    out = None
    for df, sign in zip(changes, (-1, 1)):
        if df is not None:
            exact = {m: F.coalesce(F.col(m).cast(EXACT), F.lit(0).cast(EXACT)) * sign for m in measures}
            part = df.withColumns({**{m: c.cast(EXACT) for m, c in exact.items()}, "_rows": F.lit(sign).cast("bigint")})
            out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class SumState:
    """Sums of measures by key; ``types`` are those of the key columns. NULL keys are left out."""

    folder: str
    keys: tuple[str, ...]
    types: tuple[T.DataType, ...]
    measures: tuple[str, ...] = ()
    buckets: int = 16

    @property
    def mirror(self) -> Mirror:
        fields = [T.StructField(k, t) for k, t in zip(self.keys, self.types)]
        fields += [T.StructField(m, T.DecimalType(38, 9)) for m in self.measures]
        fields += [T.StructField(c, T.LongType()) for c in ("_rows", "_refresh")]
        return Mirror(self.folder, T.StructType(fields), self.keys, ("_refresh",), self.buckets)

    def _summed(self, rows: DataFrame) -> DataFrame:
        sums = [F.sum(m).cast(EXACT).alias(m) for m in self.measures]
        return rows.groupBy(*self.keys).agg(*sums, F.sum("_rows").alias("_rows"))

    def apply(self, spark: SparkSession, rows: DataFrame, refresh: int) -> DataFrame:
        """Add signed rows under the number of a refresh, and give the first keys that they touch.

        A refresh that has been applied is not applied again, so one that died half way can be repeated.
        """
        for k in self.keys:
            rows = rows.where(F.col(k).isNotNull())
        delta = settle(self._summed(rows), "delta")
        last = self.mirror.last_batch(spark) or 0
        if last < refresh:
            new = delta
            if last:
                old = self.mirror.read_keys(spark, delta.select(self.keys[0]))
                old = old.join(delta.select(*self.keys), list(self.keys), "left_semi").drop("_refresh")
                new = self._summed(old.unionByName(delta))
            self.mirror.store_rows(new.withColumn("_refresh", F.lit(refresh).cast("bigint")), refresh)
        return delta.select(self.keys[0]).distinct()

    def read(self, spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
        """The sums of the keys that have rows, of all first keys or of the wanted ones."""
        rows = self.mirror.read(spark) if wanted is None else self.mirror.read_keys(spark, wanted)
        return rows.where("_rows > 0").drop("_refresh")
