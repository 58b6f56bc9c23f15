"""Groups of connected items from buckets of candidates, without all pairs of a bucket.

Two items are compared only while nothing has connected them yet. Each bucket first compares one
of its members, its hub, with all others; what links to a hub is then one group and needs no further
comparison inside. Later rounds take about four hubs, then four times as many each time, and only
members that are still in different groups are compared. After the last round every pair of a bucket has either been
compared or is connected, so no link between groups is lost, and a bucket of like items costs a few
comparisons for each member. Members of the bucket's largest group are never held against each other. A bucket of many
items that nothing connects would end in all pairs; a caller that has sharper buckets for those stops
after some rounds and goes on with what :func:`undecided` gives.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from acctlens.sources.tables import settle, unsettle

# Buckets up to this size compare all members at once: at most 3.5 pairs for each member.
SMALL_BUCKET = 8
# Up to this many larger buckets, 16 bytes each, are sent to the tasks; beyond that they are joined.
BROADCAST_BUCKETS = 200_000
# Members of one bucket that one join key holds; larger buckets are split over several keys.
SPLIT = 4096


def free_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of results that are written and done with."""
    gc.collect()
    # Python's references to the JVM's objects are given up by a thread of their own; before that they keep the shuffles.
    time.sleep(0.2)
    df.sparkSession._jvm.System.gc()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every item of ``edges`` (a, b) that is not the smallest of its component.

    Alternates the two star steps of map-reduce connected components until nothing changes: every
    node tells its larger, then its smaller neighbours the smallest one it knows.
    """
    edges = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges, old = settle(small.distinct(), "edges"), edges
        unsettle(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def sizes_within(least: float) -> Column:
    """The sizes of members x and y are in no smaller a ratio than this."""
    return F.least("x.size", "y.size") >= F.lit(least) * F.greatest("x.size", "y.size")


def company(members: DataFrame) -> DataFrame:
    """(bucket, id, n) of the members (bucket long, id long) of buckets with company, as a written table; n is the bucket's size.

    Most buckets hold one member, and most others two: one aggregate finds both, and only the members
    of larger buckets are looked up.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    sizes = settle(sizes.where("n > 1"), "sizes")
    free_shuffles(sizes)
    twos = sizes.where("n = 2").select("bucket", F.explode(F.array("low", "high")).alias("id"), "n")
    larger = sizes.where("n > 2").select("bucket", "n")
    if larger.count() <= BROADCAST_BUCKETS:
        larger = F.broadcast(larger)
    found = settle(twos.unionByName(members.join(larger, "bucket").select("bucket", "id", "n")), "company")
    unsettle(sizes)
    free_shuffles(found)
    return found


def shared_buckets(members: DataFrame, items: DataFrame) -> DataFrame:
    """The members (bucket long, id long) of buckets with company and their ``items``, for :func:`linked`."""
    found = company(members)
    out = with_hubs(found, items)
    unsettle(found)
    return out


def with_hubs(found: DataFrame, items: DataFrame) -> DataFrame:
    """What :func:`company` has found, as a written table, with the columns of the ``items`` (id, size, ...).

    Adds what :func:`linked` needs: the round ``level`` in which the member is a
    hub, its ``place`` among the hubs of a round, and the number of parts that the bucket is split
    into. The first hub of a bucket is the member with most company in all its buckets, as it is most
    likely to be like the others; it tends to be the same item in all buckets that it shares with
    them. The further hubs follow by a hash of the item.
    """
    shared = settle(found.join(items, "id"), "shared")
    free_shuffles(shared)
    noise = F.pmod(F.xxhash64("id"), F.lit(1 << 24))
    company = shared.groupBy("id").agg((F.sum("n") * (1 << 24)).alias("company"))
    ranked = shared.join(company.withColumn("company", F.col("company") + noise), "id")
    first = ranked.groupBy("bucket").agg(F.max("company").alias("most"))
    place = noise / F.lit(1 << 24) * F.col("n")
    now = (F.col("n") <= SMALL_BUCKET) | (F.col("company") == F.col("most"))
    level = F.when(now, 0).when(F.col("place") < 4, 1).otherwise(1 + F.floor(F.log2("place") / 2).cast("int"))
    out = ranked.join(first, "bucket").withColumn("place", place).withColumn("level", level)
    out = out.withColumn("parts", (F.col("n") / SPLIT).cast("int") + 1).drop("company", "most")
    out = settle(out, "members")
    unsettle(shared)
    free_shuffles(out)
    return out


def undecided(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members of buckets that are still of several groups, with their ``root`` and whether they
    belong to the bucket's largest group (``main``). Small buckets were settled at once."""
    seen = members.where(F.col("n") > SMALL_BUCKET).drop("root", "main")
    if roots is None:
        seen = seen.withColumn("root", F.col("id"))
    else:
        seen = seen.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = seen.groupBy("bucket", F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("c"))
    mixed = groups.groupBy("bucket").agg(F.max(F.struct("c", "r")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    seen = seen.join(mixed.select("bucket", F.col("m.r").alias("r")), "bucket")
    return seen.withColumn("main", F.col("root") == F.col("r")).drop("r")


def linked(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], also: Column | None = None,
    roots: DataFrame | None = None, rounds: int | None = None,
) -> DataFrame:
    """(id, root) of the items that some chain of links ties to a smaller one.

    ``members`` comes from :func:`shared_buckets`. ``also`` is a condition on two members x and y
    without which they can't be linked. ``verify`` takes distinct pairs (a, b) and returns those
    that are links. ``roots`` holds groups known before. After ``rounds``, if given, no more hubs are compared.
    """
    possible = F.lit(True) if also is None else also
    now, empty = 0, members.select("id", F.col("id").alias("root")).where("false")
    # What this call has written and does not need any more is deleted; what it was given stays.
    own_members = own_roots = None
    while True:
        if now == rounds:
            break
        if now:
            members = settle(undecided(members, roots), "members")
            if own_members is not None:
                unsettle(own_members)
            own_members = members
        else:
            members = members.withColumn("root", F.col("id")).withColumn("main", F.lit(False))
            if roots is not None:
                members = members.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        last = members.agg(F.max("level")).first()[0]
        if last is None or last < now:
            break
        seen = members
        keyed = seen.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        hubs = seen.where(F.col("level") == now).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # Hubs of the largest group meet the members of others only.
        hubs = hubs.withColumn("meets", F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
        # Each pair of a bucket once: by the round, then by place, then by id.
        order = [F.struct(f"{m}.level", f"{m}.place", f"{m}.id") for m in "xy"]
        later = order[0] < order[1]
        same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.meets") == F.col("y.main"))
        pairs = hubs.alias("x").join(keyed.alias("y"), same & later & (F.col("x.root") != F.col("y.root")) & possible)
        pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        links = settle(verify(pairs), "links")
        free_shuffles(links)
        now += 1
        if links.isEmpty():
            unsettle(links)
            continue
        all_links = links if roots is None else links.union(roots.select("id", "root"))
        edges = connected(all_links)
        roots = settle(edges, "roots")
        unsettle(links, edges, *([] if own_roots is None else [own_roots]))
        own_roots = roots
    if own_members is not None:
        unsettle(own_members)
    return empty if roots is None else roots
