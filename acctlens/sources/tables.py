"""Table access: scan, snapshot overwrite, clustered layout, cleanup, preview."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from acctlens.schemas import parsed
from acctlens.sources.versions import VersionedTable

# Rows that the edges of a curve are taken from, and the bits of all columns' ranks.
EDGE_SAMPLE = 20_000
CURVE_BITS = 10


@dataclass(frozen=True)
class Catalog:
    """Where tables live: a directory of parquet tables, or a ``catalog.schema`` prefix."""

    directory: str | None = None
    schema: str | None = None
    suffix: str = ""

    def table(self, name: str) -> str:
        return f"{self.schema}.{name}" if self.schema else name

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}{self.suffix}"


def read_table(spark: SparkSession, cat: Catalog, name: str) -> DataFrame:
    """A table as it is now. Of a table that :func:`write_snapshot` keeps in a folder it is the newest
    version, and stays that one whatever is written later."""
    if not cat.directory:
        return spark.table(cat.table(name))
    snapshots = VersionedTable(cat.path(name))
    return snapshots.read(spark) if snapshots.numbers(spark) else spark.read.parquet(cat.path(name))


def make_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A small typed table from records (configuration and fixtures)."""
    return spark.createDataFrame(rows, schema=schema)


def literal_column(spark: SparkSession, name: str, values: list) -> DataFrame:
    """A one-column table of configured values, made without Python workers."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order and types; extra columns drop out."""
    fields = parsed(schema).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def write_snapshot(df: DataFrame, cat: Catalog, name: str) -> None:
    """Replace the table and its schema.

    In a folder the new rows become a version beside the old one, and the switch is one rename: a run that
    fails leaves the old table, and its readers go on (see :mod:`acctlens.sources.versions`).
    """
    if cat.directory:
        VersionedTable(cat.path(name)).overwrite(df)
    else:
        df.write.mode("overwrite").option("overwriteSchema", "true").format("parquet").saveAsTable(cat.table(name))


def _edges(df: DataFrame, col: str, bits: int) -> list:
    """Values that part the column's rows into 2 ** bits shares, from a sample of bounded size.

    They decide where a row lies, never what is in the table.
    """
    rows = df.select(col).where(F.col(col).isNotNull())
    share = min(1.0, EDGE_SAMPLE / max(1, rows.count()))
    seen = sorted(r[0] for r in rows.sample(share, seed=1).limit(2 * EDGE_SAMPLE).collect())
    places = [len(seen) * i // (1 << bits) for i in range(1, 1 << bits)]
    return sorted({seen[p] for p in places if p and seen[p] > seen[0]}) if seen else []


def hilbert_place(point: list[int], bits: int) -> int:
    """Place of a cell of a grid with 2 ** bits cells a side on the Hilbert curve through it, in any
    number of dimensions, by the transposition method of Skilling (2004)."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            flip ^= (1 << b) - 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ flip) >> b & 1)
    return place


def curve_key(df: DataFrame, cols: list[str]) -> Column:
    """Place on a Hilbert curve through the grid of the columns' ranks: rows that follow each other on it
    are near in every column. NULL ranks first. The grid has at most 2 ** CURVE_BITS cells."""
    bits = max(1, CURVE_BITS // len(cols))

    def rank(c: str) -> Column:
        edges = [F.lit(e) for e in _edges(df, c, bits)]
        return F.coalesce(F.size(F.filter(F.array(*edges), lambda e: e <= F.col(c))), F.lit(0)) if edges else F.lit(0)

    cells = product(range(1 << bits), repeat=len(cols))
    places = F.lit([hilbert_place(list(cell), bits) for cell in cells])
    return places[reduce(lambda cell, c: cell * F.lit(1 << bits) + rank(c), cols, F.lit(0))]


def clustered(df: DataFrame, cols: list[str], tie: str) -> DataFrame:
    """Rows in ranges of a curve through the columns' values, for min/max skipping of files by any one of them.

    The tie column joins the range key, so a value pair holding much of the table spreads over
    several files instead of filling one.
    """
    curve = "_curve"
    while curve in df.columns:
        curve += "_"
    keyed = df.withColumn(curve, curve_key(df, cols))
    return keyed.repartitionByRange(curve, *cols, tie).sortWithinPartitions(curve, *cols, tie).drop(curve)


def write_clustered(df: DataFrame, cat: Catalog, name: str, cols: list[str], tie: str) -> None:
    """The table in its clustered layout. The rows are settled first, as the curve reads its columns before."""
    write_snapshot(clustered(settle(df, name), cols, tie), cat, name)


def drop_tables(spark: SparkSession, cat: Catalog, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {cat.table(name)}")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def settle_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder.

    Where none is set (tests, notebooks) it is a folder in the session's warehouse, which all
    executors share too. The same on every master.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_acctlens"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in one folder per application."""
    app = spark.conf.get("spark.app.id", "session")
    return f"{settle_folder(spark)}/acctlens/{app}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read, and read it back.

    Cuts the lineage to files that outlive any executor. :func:`remove_settled` deletes them when
    the application is done with its results.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettle(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`settle` gave, once nothing reads them any more.

    What was made of them has to be written by then: no frame built on them can be read again.
    """
    for df in frames:
        spark = df.sparkSession
        own = f"{settle_folder(spark)}/acctlens/{spark.conf.get('spark.app.id', 'session')}"
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
            # Only what lies in this application's own folder.
            if folder.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(own).toUri().getPath():
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_settled(spark: SparkSession) -> None:
    """Delete what this application has settled; frames built on it can no longer be read."""
    app = spark.conf.get("spark.app.id", "session")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{settle_folder(spark)}/acctlens/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
