"""Outbound change feed in bounded batches, a ledger of what has been delivered, and delivery results.

A batch is one line: its id, and at most ``BATCH`` records. The id is a digest of the records' own digests, so the
same records make the same batch again, whichever task or run frames them. Files follow bytes, not batches.
The ledger is a mirror of outcomes by record id and digest of the record's body. A run sends what the ledger
does not have as delivered: new records, changed ones, and those that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acctlens.schemas import parsed
from acctlens.sources.tables import settle
from acctlens.streaming.mirror import Mirror

BATCH = 200
# Records that one group of batches is cut from; a group is what one task sorts at a time.
GROUP = 20_000
OUTCOMES = "id string, digest string, success boolean, errors string, run bigint"


def digest(body: str = "body") -> Column:
    return F.sha2(F.col(body), 256)


def frame_batches(df: DataFrame, key: str = "Id", body: str = "body", batch: int = BATCH) -> DataFrame:
    """(batch, n, line): the records in batches of at most ``batch``, each as one JSON line.

    Records are dealt to groups by a hash of id and body and numbered there, so nothing is sorted as a whole.
    The numbering follows id and digest, so it is the same in every run over the same records.
    """
    records = settle(df.select(F.col(key).cast("string").alias("id"), F.col(body).alias("body"), digest(body).alias("digest")), "records")
    groups = 1 + records.count() // GROUP
    dealt = records.withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.lit(groups)))
    order = F.array_sort(F.collect_list(F.struct("id", "digest", "body")))
    rows = dealt.groupBy("part").agg(order.alias("rows")).select("part", "rows", F.explode(
        F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / batch).cast("int"))).alias("chunk"))
    cut = rows.select(F.slice("rows", F.col("chunk") * batch + 1, F.lit(batch)).alias("rows"))
    name = F.sha2(F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["id"], r["digest"])), ","), 256)
    line = F.concat(F.lit('{"batch":"'), name, F.lit('","records":['), F.array_join("rows.body", ","), F.lit("]}"))
    return cut.select(name.alias("batch"), F.size("rows").alias("n"), line.alias("line"))


def write_outbound(df: DataFrame, path: str, key: str = "Id", body: str = "body", batch: int = BATCH) -> None:
    """The feed as files of framed batches, a batch a line. The commit of the write keeps one set of files."""
    frame_batches(df, key, body, batch).select(F.col("line").alias("value")).hint("rebalance").write.mode("overwrite").text(path)


def read_batches(spark: SparkSession, path: str, key: str = "Id") -> DataFrame:
    """(batch, line) of a written feed, a row for each record."""
    framed = F.from_json("value", "batch string, records array<string>")
    return spark.read.text(path).select(framed.alias("f")).select(F.col("f.batch").alias("batch"), F.explode("f.records").alias("line"))


def check_batches(batches: DataFrame, key: str = "Id", batch: int = BATCH) -> DataFrame:
    """One row: records, batches over the limit, and ids that occur more than once."""
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    ids = batches.groupBy(F.get_json_object("line", f"$.{key}").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    over = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("n") > batch).alias("oversized"))
    return over.withColumn("repeated_ids", ids.agg(F.count_if(F.col("n") > 1)).scalar())


def delivery_ledger(folder: str, buckets: int = 16) -> Mirror:
    """Outcomes by (id, digest); of several the one of the latest run counts."""
    return Mirror(folder, parsed(OUTCOMES), ("id", "digest"), ("run",), buckets)


def pending(df: DataFrame, ledger: Mirror, key: str = "Id", body: str = "body") -> DataFrame:
    """The records that the ledger does not have as delivered in this form. A NULL id is never delivered."""
    done = ledger.read(df.sparkSession).where("success").select(F.col("id").alias("_done_id"), F.col("digest").alias("_done_digest"))
    same = (F.col(key).cast("string") == F.col("_done_id")) & (digest(body) == F.col("_done_digest"))
    return df.join(done, same, "left_anti")


def record_outcomes(ledger: Mirror, results: DataFrame, run: int) -> None:
    """Enter the outcomes (id, digest, success, errors) of a run. A run that is entered again changes nothing:
    its outcomes have the same place. An unknown outcome counts as failed."""
    outcomes = results.select(
        F.col("id").cast("string").alias("id"), "digest", F.coalesce("success", F.lit(False)).alias("success"),
        F.col("errors").cast("string").alias("errors"), F.lit(run).cast("bigint").alias("run"))
    ledger.store_batch(outcomes, run)


def reconcile(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Delivered and failed records, in one row or one for each value of the columns ``by``, such as
    the object. An unknown outcome counts as failed."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.groupBy(*(by or [])).agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def first_errors(results: DataFrame, key: str = "id", n: int = 3) -> DataFrame:
    """The first n failed records by key with their error text."""
    failed = results.where(~F.coalesce(F.col("success"), F.lit(False)))
    return failed.select(key, "errors").orderBy(key).limit(n)
