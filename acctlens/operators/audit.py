"""Audit-log triage and checks of source addresses against network lists."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from acctlens.functions import network as net
from acctlens.operators.joins import key_counts, lookup_join
from acctlens.operators.ordered import in_ranges, merged_ranges
from acctlens.sources.tables import settle

# (column, text) pairs that mark a serving event; the match is case-sensitive (fixed values).
SERVING_PATTERNS = [
    ("service_name", "serv"), ("action_name", "serv"),
    ("action_name", "endpoint"), ("action_name", "invoc"),
]


def recent(log: DataFrame, column: str, as_of: datetime, hours: int) -> Column:
    """column > as_of - hours, with the bound in the column's own type so that it reaches the scan."""
    bound = (as_of - timedelta(hours=hours)).isoformat(sep=" ")
    return F.col(column) > F.lit(bound).cast(log.schema[column].dataType)


def audit_triage(
    log: DataFrame, as_of: datetime, hours: int = 3, patterns: list[tuple[str, str]] = SERVING_PATTERNS
) -> DataFrame:
    """Rejected calls and serving calls of the last hours, counted per call shape.

    One scan: each event is tagged with the subsets it belongs to, and an event in both counts
    twice, as a union of the two subsets would.
    """
    rejected = F.col("response.status_code") == 403
    serving = reduce(or_, [F.col(c).contains(text) for c, text in patterns])
    tags = F.array_compact(F.array(
        F.when(rejected, F.lit("403_events")), F.when(serving, F.lit("serving_events"))
    ))
    return (
        log.where(recent(log, "event_time", as_of, hours) & (rejected | serving))
        .select(
            F.explode(tags).alias("source"), "service_name", "action_name", "source_ip_address",
            F.col("user_identity.email").alias("auth_email"),
            F.col("response.status_code").alias("status_code"),
            F.col("response.error_message").alias("error_message"),
        )
        .groupBy("source", "service_name", "action_name", "source_ip_address", "auth_email",
                 "status_code", "error_message")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def sort_triage(triage: DataFrame) -> DataFrame:
    """Report order: source, most frequent first, then every other column as a tie-break."""
    rest = ["service_name", "action_name", "source_ip_address", "auth_email", "status_code", "error_message"]
    return triage.orderBy("source", F.desc("cnt"), *rest)


def subnet_rollup(df: DataFrame, ip_col: str, prefixes: tuple[int, ...] = (24, 16)) -> DataFrame:
    """Distinct networks around the observed addresses."""
    nets = F.array(*[net.subnet(F.col(ip_col), p) for p in prefixes])
    seen = df.select(ip_col).where(net.ip_to_long(F.col(ip_col)).isNotNull()).distinct()
    return seen.select(F.explode(nets).alias("cidr")).distinct()


def cidr_match(df: DataFrame, ip_col: str, networks: DataFrame, repeats: bool = False) -> DataFrame:
    """Adds ``in_allowed``: the address lies in any network of ``networks`` (column cidr).

    Both address families. Distinct addresses and the networks' ends are numbers and go through one ordered
    pass (:func:`acctlens.operators.ordered.in_ranges`), so the list may be as long as the log. What is no
    address or no network matches nothing. Set ``repeats`` where many rows may be equal in all columns. For
    a short configured list use :func:`acctlens.functions.network.in_networks` instead.
    """
    number = "number" if ip_col != "number" else "number_"
    # Written, as it is read for the numbers and for the hot addresses of the join.
    counts = settle(key_counts(df, ip_col).withColumn(number, net.ip_number(F.col(ip_col))), "addresses")
    ranges = networks.select(net.network_range(F.col("cidr")).alias("r")).where("r IS NOT NULL").select("r.*")
    points = counts.select(ip_col, number).where(F.col(number).isNotNull())
    hits = in_ranges(points, number, ranges, "in_allowed").where("in_allowed").select(ip_col, "in_allowed")
    flagged = lookup_join(df, hits, ip_col, counts=counts.drop(number), repeats=repeats)
    return flagged.withColumn("in_allowed", F.coalesce("in_allowed", F.lit(False)))


def merged_networks(networks: DataFrame) -> DataFrame:
    """(family, first, last) of the disjoint ranges that the networks (column cidr) cover, IPv4 as numbers;
    of IPv6 the upper and lower 64 bits, each less 2 ** 63."""
    ranges = networks.select(net.network_range(F.col("cidr")).alias("r")).where("r IS NOT NULL").select("r.*")
    merged = merged_ranges(ranges)
    return merged.select(
        "first.family", F.col("first.high").alias("first_high"), F.col("first.low").alias("first_low"),
        F.col("last.high").alias("last_high"), F.col("last.low").alias("last_low"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
