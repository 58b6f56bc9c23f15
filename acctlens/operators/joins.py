"""Joins that stay balanced when one key, or the NULL key, holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# There are at most this many hot keys, which bounds the rows that lookup_join broadcasts.
MOST_HOT_KEYS = 100_000


def hot_share(df: DataFrame) -> float:
    """The share of rows above which a key is hot: half of what one reducer gets on average."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 / min(max(2 * tasks, 1000), MOST_HOT_KEYS)


def key_counts(df: DataFrame, key: str, n: str = "_n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(n))


def hot_keys(counts: DataFrame, key: str, n: str = "_n", share: float | None = None) -> DataFrame:
    """Keys above the share of all counted rows: at most 1 / share rows."""
    share = hot_share(counts) if share is None else share
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) > total * F.lit(share)).select(key)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    counts: DataFrame | None = None,
    null_safe: bool = False,
    share: float | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Add the columns of ``dim`` (one row per key) to ``fact``, whatever the key distribution.

    Rows of hot keys take their values from a broadcast of the hot dimension rows, at most
    1 / share of them and never more than MOST_HOT_KEYS. All rows then go through one shuffle join in
    which the hot rows and the NULL keys carry a slot hashed from the whole row, so no reducer
    receives a whole hot key. ``counts`` (key, _n) saves the counting pass where the caller already
    has it. Equal rows have equal slots: where many rows may be equal in all columns set
    ``repeats``, and they are joined once and repeated afterwards.
    """
    if repeats:
        once = fact.groupBy(*fact.columns).agg(F.count(F.lit(1)).alias("_times"))
        out = lookup_join(once, dim, key, how, counts, null_safe, share)
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
        return out.withColumn("_copy", copies).drop("_times", "_copy")
    counts = key_counts(fact, key) if counts is None else counts
    if not null_safe:
        # Said here, the filter is the same in every use of the counts, and so they are made once.
        counts = counts.where(F.col(key).isNotNull())
    values = [c for c in dim.columns if c != key]
    hot = hot_keys(counts, key, share=share).withColumnRenamed(key, "_h")
    # An inner join on unique keys, not a semi join: that one would be pushed into the dimension's
    # own plan and keep its two uses from sharing their shuffles.
    hot_dim = dim.join(F.broadcast(hot), _same(F.col(key), F.col("_h"), null_safe)).select(
        F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"),
        *[F.col(c).alias(f"_hot_{i}") for i, c in enumerate(values)],
    )
    tagged = fact.join(F.broadcast(hot_dim), _same(F.col(key), F.col("_hot_key"), null_safe), "left")

    hashable = [f.name for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.col("_hot").isNotNull()
    if not null_safe:
        spread = spread | F.col(key).isNull()
    tagged = tagged.withColumn(
        "_slot", F.when(spread, F.xxhash64(*hashable)).otherwise(F.xxhash64(key))
    )
    cold = dim.select(
        F.xxhash64(key).alias("_cold_slot"), F.col(key).alias("_cold_key"),
        F.lit(True).alias("_cold"),
        *[F.col(c).alias(f"_cold_{i}") for i, c in enumerate(values)],
    )
    joined = tagged.join(
        cold,
        (F.col("_slot") == F.col("_cold_slot"))
        & _same(F.col(key), F.col("_cold_key"), null_safe)
        & F.col("_hot").isNull(),
        "left",
    )
    if how == "inner":
        joined = joined.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    picked = [
        F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{i}")).otherwise(F.col(f"_cold_{i}")).alias(c)
        for i, c in enumerate(values)
    ]
    return joined.select(*[F.col(c) for c in fact.columns], *picked)


def _same(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def spread_null_key(df: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """Add a join key equal to ``key`` but hashed from ``by`` where ``key`` is NULL.

    Use it with :func:`left_join_on_spread`, which never matches the made-up values.
    """
    return df.withColumn(name, F.coalesce(F.col(key), F.xxhash64(by)))


def left_join_on_spread(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on ``key`` through its spread copy; rows with a NULL key match nothing."""
    right = right.withColumnRenamed(key, "_rk")
    return left.join(
        right, (F.col(spread) == F.col("_rk")) & F.col(key).isNotNull(), "left"
    ).drop("_rk")


def resolve_fk(
    child: DataFrame, mapping: DataFrame, key: str = "account_id"
) -> tuple[DataFrame, DataFrame]:
    """Children with the customer-system id of their account, and the children without one.

    ``mapping`` holds one row per ``key``. The second frame is what the load skips and counts.
    """
    keyed = mapping.where(F.col(key).isNotNull())
    joined = lookup_join(child, keyed.withColumn("_found", F.lit(True)), key)
    matched = joined.where(F.col("_found")).drop("_found")
    orphans = joined.where(F.col("_found").isNull()).select(*child.columns)
    return matched, orphans


def fk_counts(child: DataFrame, mapping: DataFrame, key: str = "account_id") -> DataFrame:
    """One row: matched and skipped children. The join sees each key once, with its count."""
    keyed = mapping.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(True).alias("_found"))
    joined = key_counts(child, key).join(keyed, F.col(key) == F.col("_k"), "left")
    n = F.col("_n")
    return joined.agg(
        F.coalesce(F.sum(F.when(F.col("_found"), n)), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), n)), F.lit(0)).alias("skipped"),
    )


def attach_owner(
    account: DataFrame, customer: DataFrame, org: DataFrame, name: str = "owner_rep_name"
) -> DataFrame:
    """Representative of the account's sales organisation, NULL where either lookup fails.

    Duplicate customer or organisation rows: the smallest value wins, so the result does not
    depend on row order.
    """
    customers = customer.groupBy("customer_shipto_key").agg(
        F.min("customer_sales_org_key").alias("customer_sales_org_key")
    )
    orgs = org.groupBy("customer_sales_org_key").agg(
        F.min(F.struct("rp_emp_first", "rp_emp_last")).alias("_rep")
    ).select(
        "customer_sales_org_key",
        F.concat(F.col("_rep.rp_emp_first"), F.lit(" "), F.col("_rep.rp_emp_last")).alias(name),
    )
    owners = lookup_join(customers, orgs, "customer_sales_org_key").select("customer_shipto_key", name)
    return lookup_join(account.drop(name), owners, "customer_shipto_key")


def classify_by_lookup(
    df: DataFrame, segments: DataFrame, key: str, default: str, out: str = "segment"
) -> DataFrame:
    """Segment of a name from a lookup table (key, segment, rank); the lowest rank wins."""
    first = segments.groupBy(key).agg(F.min_by("segment", F.struct("rank", "segment")).alias(out))
    joined = lookup_join(df, first, key)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
