"""Contiguous shards of the smallest possible largest size, from DataFrame operations only.

Rows with equal texts form an atomic group. Groups are ordered by the digest of their text, and
shards are runs of groups in that order. The smallest capacity for which greedily filled shards
suffice is searched for by bisection; many capacities are tried at once, each step of the greedy
filling being one aggregate over the running sizes. The cuts are then digests, so a row's shard
follows from its own text, without a join.

Null text: no bytes, the same group as the empty text. Null or repeated doc_id and repeated rows:
every row gets a slot of its own. Further columns are not read. An empty table gives no rows. A
group larger than an even share makes its shard that large, and no other one larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from acctlens.llm.ranks import numbered
from acctlens.sources.tables import settle

SHARDS = 8
# Capacities tried in one round of the search.
TRIED = 31


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _size() -> Column:
    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1


def running_sizes(docs: DataFrame) -> DataFrame:
    """(digest, size, upto): the groups with the running total of sizes in digest order."""
    groups = docs.select(_digest().alias("digest"), _size().alias("size"))
    groups = groups.groupBy("digest").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("_range", F.substring("digest", 1, 3))
    # 4,096 ranges of digests at most, so their totals fit a single task.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("_range").agg(F.sum("size").alias("_total"))
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    out = groups.withColumn("_upto", F.sum("size").over(upto)).join(totals, "_range")
    return out.select("digest", "size", (F.col("_base") + F.col("_upto")).alias("upto"))


def filled(groups: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, where greedily filled shards end."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        reach = [e[-1] + c for e, c in zip(ends, capacities)]
        near = groups.where(F.col("upto").between(min(e[-1] for e in ends), max(reach)))
        found = near.agg(*[F.max(F.when(F.col("upto") <= r, F.col("upto"))).alias(f"e{i}") for i, r in enumerate(reach)]).first()
        for e, best in zip(ends, found):
            e.append(e[-1] if best is None else max(e[-1], best))
    return [e[1:] for e in ends]


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of the shards under it."""
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    best = None
    while low < high or best is None:
        step = max(1, (high - low) // (TRIED + 1))
        tried = sorted({*range(low, high, step)} | {high})[: TRIED + 1]
        for capacity, ends in zip(tried, filled(groups, tried, shards)):
            if ends[-1] == total:
                high, best = capacity, ends
                break
            low = capacity + 1
    return high, best


def minimax_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row's shard and its place there; law ``bytes``: the largest shard is as small as can be."""
    groups = settle(running_sizes(docs), "shard-groups")
    _, ends = smallest_capacity(groups, shards)
    last = {r["upto"]: r["digest"] for r in groups.where(F.col("upto").isin(ends)).collect()}
    cuts = [last[e] for e in ends[:-1] if e in last]
    digest = _digest()
    shard = sum(((digest > cut).cast("int") for cut in cuts), F.lit(0))
    rows = docs.select(
        "doc_id", _size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), shard.cast("int").alias("shard"))
    rows = settle(rows, "shard-rows")
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").withColumn(
        "grown_shard", F.lit(None).cast("int"))
