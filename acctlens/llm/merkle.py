"""A Merkle manifest of the documents: a tree for each language, one tree over their roots, and a proof
for each document, checked against a copy of the documents that may have been tampered with.

A leaf is the digest of a row's fields, each written with its length. The leaves of a language, in order
of doc_id, are joined eight by eight until one node is left, the language's subroot; the subroots, in order
of language, are joined likewise into the root. All nodes are stored as rows that name their parent and
hold the digests of their siblings. A recursive query then climbs from the leaves: each step joins a row
with its node, appends the node's siblings to the proof, and folds the siblings into the digest that the
possibly tampered leaf began with. The eight leaves of one run climb in one row, each with its own folded
digest, as they have all further siblings in common.

Rows are put in order by ranges, and places come from the ranges' sizes, so no language is sorted in
one task. A node near a root is met by very many climbing rows: it is stored once for every
``SPREAD`` of them, and each row goes to one of the copies by a salt.

Nulls: a null field is written as ``-``. A null language is a tree of its own, before all others. Rows
with a null doc_id come first in their language and are never tampered with. Equal doc_ids: by digest
of the row, so repeated rows are leaves side by side. A language with one document: the leaf is the subroot.
Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from acctlens.sources.tables import settle

ARITY = 8
# Rows of the climb that meet in one key.
SPREAD = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """A field as it enters its leaf: its length in bytes and its text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Digest of a row, with some of its fields changed."""
    return F.sha2(F.concat(*[written(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered() -> Column:
    """Which rows of the copy have been tampered with; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def lower_cased() -> Column:
    """What the tampering does to the text: A-Z in lower case."""
    return F.translate("text", string.ascii_uppercase, string.ascii_lowercase)


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, start, row): ``start`` is the tampered row's digest, null for others."""
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    start = F.when(tampered(), leaf(text=lower_cased()))
    return docs.select(tree.alias("tree"), "doc_id", leaf().alias("leaf"), start.alias("start"), F.monotonically_increasing_id().alias("row"))


def placed(table: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``: 0, 1, ... by the order columns within each ``tree``.

    ``table`` is a written table. Rows are dealt out by ranges and sorted there; the sizes of the
    ranges before it give a row's place, so nothing holds a whole tree.
    """
    ranged = table.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = settle(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    # The upper bits of this number are the range, the lower ones count its rows.
    ranged = ranged.select("*", F.shiftright("at", 33).alias("range"))
    sizes = ranged.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return ranged.join(bases, ["tree", "range"]).withColumn("place", F.col("at") + F.col("base")).drop("at", "range", "base")


def _above(level: DataFrame, *entry: str) -> DataFrame:
    """(tree, place, entries): runs of ARITY neighbours, their columns ``entry`` in order of place."""
    run = F.struct(F.col("place").alias("at"), *entry)
    return level.groupBy("tree", F.floor(F.col("place") / ARITY).alias("run")).agg(
        F.array_sort(F.collect_list(run)).alias("entries")).withColumnRenamed("run", "place")


def _lone() -> Column:
    """The run of a tree that has one node only."""
    return (F.col("place") == 0) & (F.size("entries") == 1)


def _joined(digests: Column) -> Column:
    """Digest of some digests as one hexadecimal text."""
    return F.sha2(F.array_join(digests, ""), 256)


def _name(kind: str, level: int) -> Column:
    return F.concat_ws(":", F.lit(f"{kind}{level}"), "place", "tree")


def _grown(level: DataFrame, kind: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Build a tree's levels above (tree, place, node, digest, rows), which lie at ``height``.

    Gives the runs of each level, as written tables, with the node they make, and the tops
    (tree, node, digest, rows). ``rows``: how many climbing rows come by a node.
    """
    runs, tops = [], []
    while True:
        above = settle(_above(level, "node", "digest", "rows"), "level")
        tops.append(above.where(_lone()).select("tree", F.inline("entries")).drop("at"))
        above = above.where(~_lone()).select(
            "tree", "place", "entries", _name(kind, height + 1).alias("node"), _joined(F.col("entries.digest")).alias("digest"),
            F.aggregate("entries.rows", F.lit(0).cast("long"), lambda a, n: a + n).alias("rows"))
        if above.isEmpty():
            break
        runs.append(above)
        level, height = above, height + 1
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return runs, top


def _steps(runs: DataFrame, subroots: bool) -> DataFrame:
    """The stored node rows: (node, part, before, after, next, next_parts, subroot), siblings as bytes."""
    def side(low: Column, many: Column) -> Column:
        return F.unhex(F.array_join(F.slice(F.col("entries.digest"), low, many), ""))

    node = F.col("entries")[F.col("i")]
    parts = (node["rows"] / SPREAD).cast("long")
    kids = runs.select("*", F.explode(F.sequence(F.lit(0), F.size("entries") - 1)).alias("i"))
    return kids.select(
        node["node"].alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"),
        side(F.lit(1), F.col("i")).alias("before"), side(F.col("i") + 2, F.lit(ARITY)).alias("after"),
        F.col("node").alias("next"), ((F.col("rows") / SPREAD).cast("long") + 1).alias("next_parts"),
        (node["digest"] if subroots else F.lit(None).cast("string")).alias("subroot"))


CLIMB = """
WITH RECURSIVE climb AS (
    SELECT tree, place, node, CAST(0 AS BIGINT) AS part, folds, CAST('' AS BINARY) AS proof, CAST(NULL AS STRING) AS subroot
    FROM {starts}
    UNION ALL
    SELECT c.tree, c.place, s.next, pmod(xxhash64(c.tree, c.place), s.next_parts),
           transform(c.folds, f -> unhex(sha2(lower(concat(hex(s.before), hex(f), hex(s.after))), 256))),
           concat(c.proof, s.before, s.after), coalesce(c.subroot, s.subroot)
    FROM climb c JOIN {steps} s ON s.node = c.node AND s.part = c.part)
SELECT tree, place, folds, proof, subroot FROM climb WHERE node = :root"""


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursive query at a million rows unless it is told otherwise."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame], tuple | None]:
    """The built tree of a table: (runs of leaves, subroots, levels as (runs, above the subroots), root).

    The runs of leaves are (tree, place, entries); subroots are (tree, node, digest, rows); the root is
    (node, digest), None for an empty table.
    """
    leaves = placed(settle(_leaves(docs), "leaves"), ["doc_id", "leaf", "row"])
    runs = settle(_above(leaves, "doc_id", "leaf", "start"), "runs")
    node = F.when(_lone(), _name("leaf", 0)).otherwise(_name("lang", 1))
    digest = F.when(_lone(), F.col("entries")[0]["leaf"]).otherwise(_joined(F.col("entries.leaf")))
    first = runs.select("tree", "place", node.alias("node"), digest.alias("digest"), F.lit(1).cast("long").alias("rows"))
    below, tops = _grown(first, "lang", 1)
    tops = settle(tops, "subroots")
    ranked = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node", "digest", "rows"), ["lang"])
    above, top = _grown(ranked, "root", 0)
    # At most one row.
    root = top.select("node", "digest").first()
    return runs, tops, [*[(r, False) for r in below], *[(r, True) for r in above]], root


def proofs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    spark = docs.sparkSession
    runs, _, levels, root = manifest(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if root is None:
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def siblings(i: Column) -> tuple[Column, Column]:
        return F.slice("entries.leaf", F.lit(1), i), F.slice("entries.leaf", i + 2, F.lit(ARITY))

    def folded(entry: Column, i: Column) -> Column:
        start = F.coalesce(entry["start"], entry["leaf"])
        before, after = siblings(i)
        return F.unhex(F.when(_lone(), start).otherwise(_joined(F.concat(before, F.array(start), after))))

    node = F.when(_lone(), _name("leaf", 0)).otherwise(_name("lang", 1))
    starts = runs.select("tree", "place", node.alias("node"), F.transform("entries", folded).alias("folds"))
    if levels:
        steps = [_steps(*level) for level in levels]
        all_steps = steps[0]
        for more in steps[1:]:
            all_steps = all_steps.unionByName(more)
        with _unlimited(spark):
            done = spark.sql(CLIMB, args={"root": root["node"]}, starts=starts, steps=settle(all_steps, "nodes"))
            done = settle(done, "climbed")
    else:
        done = starts.select("tree", "place", "folds", F.lit(b"").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    out = runs.join(done, ["tree", "place"])
    own = F.transform("entries", lambda entry, i: F.array_join(F.concat(*siblings(i)), ""))
    out = out.select("subroot", F.lower(F.hex("proof")).alias("proof"), F.inline(F.arrays_zip("entries", "folds", own.alias("own"))))
    folded_root = F.lower(F.hex("folds"))
    return out.select(
        "entries.doc_id", "entries.leaf", F.coalesce("subroot", F.lit(root["digest"])).alias("subroot"), F.lit(root["digest"]).alias("root"),
        F.sha2(F.concat("own", "proof"), 256).alias("proof_sha256"), folded_root.alias("folded_root"),
        (folded_root == F.lit(root["digest"])).alias("verified"))
