"""Whitening of embeddings: principal components by contour integration, scaled to unit variance.

An entry becomes the whole number floor(64 * entry) + 1000000. Sums are exact; the covariance is summed up
from centred rows. Tables are read by tasks that each give one matrix as wide as the vectors, and those
are added in groups. The axis of eigenvalues is cut into intervals by inertia, each interval's eigenpairs
are one row of a Spark job (:mod:`feast`), and a last Rayleigh-Ritz step over all of them makes the components
orthogonal across intervals. A whitened row is the centred row projected on a component over the root of its eigenvalue.

Rows without a vector, or with an entry that is null, not finite, or beyond ``LARGEST``, are dropped. Vectors
must be of one width: the most frequent one counts, the wider of two as frequent, and others are dropped. Components whose eigenvalue
is zero but for rounding do not exist: they would be divided by zero. So equal vectors, a single vector, empty vectors
and an empty table give no rows. Repeated rows count as often as they occur; null and repeated ids pass through. A deviation
that exceeds a long is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from acctlens.llm import feast

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**40
COMPONENTS = 32
# Numbers that one row carries while sums are added up.
SLICE = 4096
# Groups in which the tasks' sums are added up first.
GROUPS = 64
PARTIAL = "part long, slice int, whole boolean, values binary"


def usable(table: DataFrame, column: str = "embedding") -> DataFrame:
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return table.where(F.coalesce(fine, F.lit(False)))


def integers(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column, of one width, as rows of whole numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(vectors), -1) * SCALE).astype(np.int64) + SHIFT


def _summed(table: pa.Table) -> pa.Table:
    kind = np.int64 if table.column("whole")[0].as_py() else np.float64
    values = sum(np.frombuffer(v.as_py(), kind) for v in table.column("values"))
    out = {"part": [table.column("part")[0].as_py()], "slice": [table.column("slice")[0].as_py()],
           "whole": [kind is np.int64], "values": [values.tobytes()]}
    return pa.table(out, schema=pa.schema([("part", pa.int64()), ("slice", pa.int32()), ("whole", pa.bool_()), ("values", pa.binary())]))


def totals(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of what ``of`` gives for a batch of them; none of an empty table.

    Tasks add up their batches, then ``GROUPS`` groups of tasks, then all of those. The result is as long as the vectors are wide, or the square of it.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if len(part):
                own = of(integers(part.column("embedding"))).ravel()
                total = own if total is None else total + own
        if total is not None:
            cut = [total[i : i + SLICE] for i in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()),
                pa.array([total.dtype == np.int64] * len(cut)), pa.array([c.tobytes() for c in cut], pa.binary())],
                ["part", "slice", "whole", "values"])

    sums = vectors.select("embedding").mapInArrow(run, PARTIAL)
    sums = sums.withColumn("part", F.pmod("part", F.lit(GROUPS))).groupBy("part", "slice").applyInArrow(_summed, PARTIAL)
    rows = sums.withColumn("part", F.lit(0).cast("long")).groupBy("slice").applyInArrow(_summed, PARTIAL).collect()
    if not rows:
        return None
    kind = np.int64 if rows[0]["whole"] else np.float64
    return np.concatenate([np.frombuffer(r["values"], kind) for r in sorted(rows, key=lambda r: r["slice"])])


def components(spark: SparkSession, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors in columns; an interval is a row of the job."""
    width = len(covariance)
    intervals = feast.Inertia(covariance).intervals(wanted)
    if not intervals:
        return np.zeros(0), np.zeros((width, 0))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in part.column("id").to_pylist():
                values, vectors = feast.eigenpairs(covariance, *intervals[i])
                yield pa.RecordBatch.from_arrays([
                    pa.array([i] * len(values), pa.int64()), pa.array(values), pa.array([v.tobytes() for v in vectors.T], pa.binary())],
                    ["id", "value", "vector"])

    rows = spark.range(0, len(intervals), 1, len(intervals)).mapInArrow(run, "id long, value double, vector binary").collect()
    space = np.stack([np.frombuffer(r["vector"]) for r in sorted(rows, key=lambda r: (r["id"], -r["value"]))], axis=1)
    values, vectors = feast.ritz(covariance, space)
    return values[::-1][:wanted], vectors[:, ::-1][:, :wanted]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the entries of (n * x - S) ** 2, exact."""
    rough = ((x.astype(np.float64) * n - sums) ** 2).sum(axis=1)
    # Differences that fit are right even where the product wraps around.
    off = x * np.int64(n) - sums
    out: list[int | None] = (off * off).sum(axis=1).tolist()
    for i in np.flatnonzero(rough > 2.0**61).tolist():
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(table: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Per row with a usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = usable(table).select("vec_id", "embedding")
    widths = good.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.where("width > 0").orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if width is None:
        return spark.createDataFrame([], schema)
    good, n = good.where(F.size("embedding") == width["width"]), width["n"]
    sums = totals(good, lambda x: x.sum(axis=0))
    mean = sums / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = totals(good, products).reshape(len(sums), -1) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(spark, covariance, wanted)
    if not len(values):
        return spark.createDataFrame([], schema)
    explained, scaled = values / np.trace(covariance), vectors / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ scaled

    middle = totals(good, lambda x: whitened(x).sum(axis=0)) / n

    def white_products(x: np.ndarray) -> np.ndarray:
        centred = whitened(x) - middle
        return centred.T @ centred

    error = totals(good, white_products).reshape(len(values), -1) / n - np.eye(len(values))
    error, k = float(abs(error).max()), len(values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            x = integers(part.column("embedding"))
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(row),
                pa.array(whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)
