"""Continuous ingest of change records into a log-structured mirror, from which the latest row per key is read.

A mirror is a versioned table. Its base holds one row per key, in a fixed number of buckets by a hash of the
key; each micro-batch adds a delta, the newest row per key of the batch. When there are as many deltas as
``max_deltas``, they are merged into the buckets that they touch, and only those are written again. A reader
sees one version: base buckets and deltas, of which the newest row per key counts. So a read opens at most
one folder for each bucket and delta, however many batches there have been.

The order columns alone decide between rows of a key, so a late record loses whenever it arrives and a
batch that is stored again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from acctlens.operators.rollups import newest_rows
from acctlens.sources.versions import Files, Version, VersionedTable

ORDER = ["change_ts", "change_seq"]


@dataclass(frozen=True)
class Mirror:
    """A mirrored object: schema, key, order of changes, and its shared folder.

    A key of several columns has its bucket from the first. Size ``buckets`` so that one bucket of the
    base is some hundred megabytes.
    """

    folder: str
    schema: T.StructType
    key: str | tuple[str, ...] = "Id"
    order: tuple[str, ...] = tuple(ORDER)
    buckets: int = 16
    max_deltas: int = 16

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(self.folder)

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return newest_rows(rows.select(*self.schema.names), self.keys, list(self.order))

    def store_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Add the batch's newest row per key as a delta, and merge the deltas if they have become many."""
        self.store_rows(self._newest(batch), batch_id)

    def store_rows(self, rows: DataFrame, batch_id: int, said: dict | None = None) -> None:
        """:meth:`store_batch` of rows that have each key once, with words for :meth:`said`."""
        spark = rows.sparkSession
        base = self.table.version(spark)
        notes = base.notes or {"base": {}, "deltas": []}
        # Files follow the batch's size, not the number of reducers.
        delta = self.table.stage(rows.select(*self.schema.names).hint("rebalance"))
        notes = {**notes, "deltas": [*notes["deltas"], delta], "last_batch": batch_id, "said": said or {}}
        version = self._commit(spark, base, notes)
        if len(notes["deltas"]) >= self.max_deltas:
            self.compact(spark, version)

    def _commit(self, spark: SparkSession, version: Version, notes: dict) -> Version:
        return self.table.commit(spark, version, [*notes["base"].values(), *notes["deltas"]], self.schema, notes)

    def compact(self, spark: SparkSession, version: Version | None = None) -> None:
        """Merge all deltas into the buckets of the base that they touch; other buckets stay as they are."""
        version = version or self.table.version(spark)
        if not version.number or not version.notes["deltas"]:
            return
        base, bucket = version.notes["base"], "_bucket"
        fresh = self._frame(spark, version.notes["deltas"])
        # No more values than buckets.
        touched = sorted(r[0] for r in fresh.select(self._bucket().alias(bucket)).distinct().collect())
        old = self._frame(spark, [base[str(k)] for k in touched if str(k) in base])
        merged = self._newest(old.unionByName(fresh)).withColumn(bucket, self._bucket())
        name = self.table.stage(merged.repartition(len(touched) or 1, bucket), bucket)
        written = set(Files(spark, self.folder).names(name))
        base = base | {str(k): f"{name}/{bucket}={k}" for k in touched if f"{bucket}={k}" in written}
        self._commit(spark, version, {**version.notes, "base": base, "deltas": []})

    def _frame(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return self.table.frame(spark, Version(1, tuple(folders), self.schema))

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """Current row per key, or that of an earlier version; none before the first batch. Deleted rows
        stay, flagged, as the metrics expect."""
        version = self.table.version(spark, number)
        if not version.number:
            return spark.createDataFrame([], self.schema)
        rows = self._frame(spark, version.folders)
        # The base alone has one row per key already.
        return self._newest(rows) if version.notes["deltas"] else rows.select(*self.schema.names)

    def buckets_of(self, wanted: DataFrame) -> set[str]:
        """The buckets that some values of the first key column fall in."""
        return {str(r[0]) for r in wanted.select(self._bucket()).distinct().collect()}

    def read_keys(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """Current rows whose first key column is among ``wanted``, a frame of that column. Of the base
        only the buckets of those keys are opened."""
        version, key = self.table.version(spark), self.keys[0]
        if not version.number:
            return spark.createDataFrame([], self.schema)
        base = version.notes["base"]
        touched = self.buckets_of(wanted) if base else set()
        folders = [f for k, f in base.items() if k in touched]
        rows = self._frame(spark, [*folders, *version.notes["deltas"]])
        return self._newest(rows.join(wanted.select(key).distinct(), key, "left_semi"))

    def last_batch(self, spark: SparkSession) -> int | None:
        """Number of the batch that was stored last."""
        return self.table.version(spark).notes.get("last_batch")

    def said(self, spark: SparkSession) -> dict:
        """What the writer of the last batch has said of it."""
        return self.table.version(spark).notes.get("said", {})

    def changed_keys(self, spark: SparkSession, since: int) -> DataFrame | None:
        """Keys of the rows that came after a version; None if they have been merged into the base since."""
        now, then = self.table.version(spark), self.table.version(spark, since)
        if then.number and now.notes["base"] != then.notes["base"]:
            return None
        known = set(then.notes["deltas"]) if then.number else set()
        return self._frame(spark, [d for d in now.notes.get("deltas", []) if d not in known]).select(*self.keys).distinct()


def start_mirror(
    spark: SparkSession, mirror: Mirror, source: str, checkpoint: str, fmt: str = "json",
    available_now: bool = True, max_files: int | None = None,
) -> StreamingQuery:
    """Ingest change files from a folder. With ``available_now`` the query ends by itself."""
    reader = spark.readStream.schema(mirror.schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = (
        reader.load(source).writeStream.foreachBatch(mirror.store_batch)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return writer.trigger(**trigger).start()
