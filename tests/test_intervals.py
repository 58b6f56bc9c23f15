"""Addresses as numbers, merged ranges and the ordered range lookup, against the ipaddress module and brute force."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from acctlens.functions import network as net
from acctlens.operators import audit, ordered
from acctlens.queries import registry

WRITTEN = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "", "x", ":", "::", ":::", "::1", "1::", "1::2::3",
    "2001:db8::5", "2001:DB8:1:2:3:4:5:6", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "7fff::ffff", "::ffff:1.2.3.4", "::1.2.3.256",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "2001:db8::10000", "2001:db8:::", ":1", "1:",
    "1:2:3:4:5:6:1.2.3.4", "g::", "1" * 60 + "::", "fe80::1%eth0",
]


def number(text):
    """(family, high, low) by the ipaddress module."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    n = int(a)
    return (4, 0, n) if a.version == 4 else (6, (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63))


def test_numbers(frame):
    df = frame([(t,) for t in WRITTEN] + [(None,)], "ip string").select("ip", net.ip_number(F.col("ip")).alias("n"))
    for r in df.collect():
        want = None if r["ip"] is None or "%" in r["ip"] else number(r["ip"])
        assert (None if r["n"] is None else tuple(r["n"])) == want, r["ip"]


def test_network_ranges(frame):
    r = random.Random(1)
    cidrs = [f"{ipaddress.ip_address(r.getrandbits(32))}/{p}" for p in range(33)] + [f"{ipaddress.IPv6Address(r.getrandbits(128))}/{p}" for p in range(129)]
    df = frame([(c,) for c in cidrs], "cidr string").select("cidr", net.network_range(F.col("cidr")).alias("r"))
    for row in df.collect():
        want = ipaddress.ip_network(row["cidr"], strict=False)
        assert tuple(map(tuple, row["r"])) == (number(str(want[0])), number(str(want[-1]))), row["cidr"]


def test_merged_ranges_and_points(frame, spark):
    r = random.Random(2)
    for width in (3, 40):
        ranges = [(a := r.randrange(2000), a + r.randrange(width)) for _ in range(150)] + [(50, 40), (None, 3), (7, None)]
        df = frame(ranges, "first bigint, last bigint")
        covered = {i for a, b in ranges if a is not None and b is not None for i in range(a, b + 1)}
        merged = sorted(map(tuple, ordered.merged_ranges(df).collect()))
        assert {i for a, b in merged for i in range(a, b + 1)} == covered
        assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
        points = spark.range(-5, 2100).select(F.col("id").alias("_point"), F.lit(1).alias("_end")).union(frame([(None, 2)], "a bigint, b int"))
        out = ordered.in_ranges(points, "_point", df, "inside").collect()
        assert len(out) == 2106 and {x["_point"] for x in out if x["inside"]} == covered
    assert ordered.merged_ranges(frame([], "first bigint, last bigint")).collect() == []


def test_running_max(frame):
    rows = [(i, (i * 37) % 100 if i % 3 else None) for i in range(300)]
    for itself in (True, False):
        out = ordered.running_max(frame(rows, "_at bigint, v bigint"), ["_at"], "v", "m", itself).orderBy("_at").collect()
        for i, r in enumerate(out):
            seen = [v for _, v in rows[: i + itself] if v is not None]
            assert r["m"] == (max(seen) if seen else None)


def test_match_of_both_families(frame):
    r = random.Random(3)
    ips = [str(ipaddress.ip_address((10 << 24) + r.getrandbits(14))) for _ in range(300)] + [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (r.getrandbits(12) << 60))) for _ in range(300)]
    ips += ["10.0.0.7"] * 500 + [None] * 100 + ["bad"]
    cidrs = [f"10.0.{r.randrange(64)}.{r.randrange(256)}/{r.choice([24, 28, 30, 32])}" for _ in range(40)]
    cidrs += [f"2001:db8:0:{r.getrandbits(12) << 4:x}::/{r.choice([56, 60, 64, 70])}" for _ in range(40)] + ["junk"]
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs if c != "junk"]
    df = frame([(i, ip) for i, ip in enumerate(ips)], "number bigint, ip string")
    out = audit.cidr_match(df, "ip", frame([(c,) for c in cidrs], "cidr string")).collect()
    assert len(out) == len(ips)
    for row in out:
        inside = number(row["ip"] or "") is not None and any(ipaddress.ip_address(row["ip"]) in n for n in nets)
        assert row["in_allowed"] is inside, row


@pytest.mark.parametrize("name", ["cidr_match", "network_ledger"])
def test_plans_stay_small(spark, sf_dir, name):
    start = time.perf_counter()
    df = registry()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
    df._jdf.queryExecution().executedPlan()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan
    # Includes the two tables that are written on the way.
    assert time.perf_counter() - start < 30
