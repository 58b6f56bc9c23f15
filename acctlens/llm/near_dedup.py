"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its set of five-word shingles, all of weight one however often they are repeated, as in the
similarity that decides. Every shingle is a Poisson process of the rate of its weight, whose arrivals fall on the signature's
places at random; a place keeps its earliest arrival. A process stops as soon as it is later than
the latest place, so most shingles of a long text end after one or two arrivals. The chance that two
documents agree in a place is the Jaccard similarity of their sets.

Bands of the signature name the candidates. A pair is a link if the exact Jaccard similarity of the
two shingle sets is at least the threshold; classes are the connected documents. Equal texts are one
item throughout, so copies are never compared.

Members of one large bucket that the first hubs don't connect (such as copies that are 0.6 to 0.8 alike) are
parted further by their rare shingles, without loss: in any common order of all shingles, two sets of sizes m and n that share
at least o share one among the first m - o + 1 of the one and n - o + 1 of the other. With the rarest first, what
an edited copy has of its own comes before the passage that the whole group shares.

Words are parted by ASCII white space, A-Z in lower case. A text under five words is one shingle of
all its words. Null text: a class of its own. Texts without a word: equal texts share a class,
others are not compared. Repeated rows are copies. Null doc_id: allowed; a class's id is its smallest
doc_id that is not null, if any. Further columns pass through ``drop_near_duplicates`` untouched and
are not read by ``near_duplicates``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acctlens.llm.linking import linked, shared_buckets, sizes_within, undecided
from acctlens.llm.rows import packed_rows, unpacked_rows
from acctlens.llm.textbytes import Texts, chunks, mixed
from acctlens.operators.joins import lookup_join
from acctlens.sources.tables import settle

SHINGLE = 5
THRESHOLD = 0.8
# At the threshold a pair shares a band with a chance above 0.9994.
BANDS, ROWS = 25, 6

# Rounds of hubs (1, then some 4 of a bucket) before rare shingles part what is left.
HUB_ROUNDS = 2
# Counters that the rarity of shingles is read from. They order the work; any order gives the same links.
CELLS = 1 << 18

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of the texts, repeated ones too, in the order of the texts."""
    first, value = t.windows(SHINGLE)
    owner = t.word_text[first]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < SHINGLE))
    if not len(short):
        return owner, value
    # The whole of a short text, with its number of words so that it differs from a word's hash.
    extra = []
    for i in short:
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in t.word_hashes[t.word_bounds[i] : t.word_bounds[i + 1]]:
                total = total * np.uint64(0xD6E8FEB86659FD93) + h
        extra.append(total)
    owner = np.concatenate([owner, short])
    value = np.concatenate([value, mixed(np.array(extra, np.uint64) ^ t.n_words[short].astype(np.uint64))])
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def prob_min_hash(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, places: int) -> np.ndarray:
    """Signatures (n x places) of n weighted sets given as parallel arrays; an empty set has zeros.

    Places are drawn from ten bits of a random number, so there are 1,024 at most.
    """
    if places > 1024:
        raise ValueError("at most 1024 places")
    earliest = np.full(n * places, np.inf)
    names = np.zeros(n * places, np.uint64)
    active = np.arange(len(owner))
    clock = np.zeros(len(owner))
    drawn, many = 0, 1
    while len(active):
        index = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64)
        random = mixed(value[active][:, None] + index * GOLDEN)
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = clock[:, None] + np.cumsum(gaps, axis=1) / weight[active][:, None]
        at = owner[active][:, None] * places + (((random & np.uint64(1023)) * np.uint64(places)) >> np.uint64(10)).astype(np.int64)
        shingle = np.broadcast_to(value[active][:, None], at.shape).ravel()
        clock, at, times = times[:, -1], at.ravel(), times.ravel()
        np.minimum.at(earliest, at, times)
        won = times == earliest[at]
        names[at[won]] = shingle[won]
        latest = earliest.reshape(n, places).max(axis=1)
        going = clock < latest[owner[active]]
        active, clock = active[going], clock[going]
        drawn += many
        many = min(2 * many, 64) if drawn > 1 else 1
    return names.reshape(n, places)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signatures), 1))
    parts = signatures.reshape(len(signatures), bands, rows)
    for k in range(rows):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return keys.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, mark, size, bands) of every row with a text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, t in chunks(part.column("text"), lower=True):
                owner, value = distinct(*shingles(t))
                size = np.bincount(owner, minlength=t.n)
                keys = band_keys(prob_min_hash(owner, value, np.ones(len(owner)), t.n, BANDS * ROWS), BANDS, ROWS)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(ends, pa.array(keys[size > 0].ravel()))
                given = [part.column(c).slice(i, j - i) for c in ("doc_id", "digest", "mark")]
                yield pa.RecordBatch.from_arrays([*given, pa.array(size, pa.int64()), bands], ["doc_id", "digest", "mark", "size", "bands"])

    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", _digest(), _mark(), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, digest binary, mark long, size long, bands array<long>")


def _digest() -> Column:
    return F.unhex(F.md5("text")).alias("digest")


def _mark() -> Column:
    """Tells rows of equal text apart by their doc_id, null included."""
    return F.xxhash64("doc_id").alias("mark")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, sorted distinct shingle hashes) of the wanted texts (id, digest, mark)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, t in chunks(part.column("text"), lower=True):
                owner, value = distinct(*shingles(t))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=t.n))]) * 8
                data = value.tobytes()
                sets = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id").slice(i, j - i), sets], ["id", "shingles"])

    texts = docs.where(F.col("text").isNotNull()).select(_digest(), _mark(), "text")
    # Repeated rows would give a set twice.
    found = texts.join(wanted, ["digest", "mark"]).dropDuplicates(["digest", "mark"])
    return found.select("id", "text").mapInArrow(run, "id long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _verifier(sets: DataFrame, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            left, right = part.column("x"), part.column("y")
            alike = [jaccard(p.as_py(), q.as_py()) >= threshold for p, q in zip(left, right)]
            yield part.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        full = full.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    return verify


def _cells(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each cell: one array of fixed size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in parts:
            for data in part.column("shingles"):
                np.add.at(total, _cells(np.frombuffer(data.as_py(), np.uint64)), 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["cell", "n"])

    found = sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest(value: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set, rarest first, among which a set as alike as the threshold has one too."""
    order = np.lexsort((value, counts[_cells(value)]))
    return value[order[: len(value) - int(np.ceil(threshold * len(value) - 1e-9)) + 1]]


def _rare_members(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id, pos): each set's rarest shingles and their places in its order."""
    counts = _rarity(sets)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for item, data in zip(part.column("id").to_pylist(), part.column("shingles")):
                first = rarest(np.frombuffer(data.as_py(), np.uint64), counts, threshold)
                ids = np.full(len(first), item, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(ids), pa.array(np.arange(len(first)))], ["bucket", "id", "pos"])

    return sets.mapInArrow(run, "bucket long, id long, pos long")


def _places_within(threshold: float) -> Column:
    """Members x and y meet among the first shingles that sets of their sizes must share one of."""
    shared = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-6))
    return (F.col("x.pos") <= F.col("x.size") - shared) & (F.col("y.pos") <= F.col("y.size") - shared)


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, root): by hubs of the bands' buckets, and by rare shingles for what these leave open."""
    verify, sized = _verifier(sets, threshold), sizes_within(threshold)
    roots = linked(members, verify, sized, rounds=HUB_ROUNDS)
    left = settle(undecided(members, roots).select("id", "size").distinct(), "left")
    if left.isEmpty():
        return roots
    rare = settle(_rare_members(sets.join(left.select("id"), "id", "left_semi"), threshold), "rare")
    again = shared_buckets(rare.select("bucket", "id"), left).join(rare, ["bucket", "id"])
    # After the same rounds of hubs all that is left of a bucket at once.
    again = again.withColumn("level", F.least("level", F.lit(HUB_ROUNDS)))
    return linked(again, verify, sized & _places_within(threshold), roots)


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, digest), texts (id, root, digest, mark, first doc_id)), both written tables."""
    signed = settle(_signed(docs), "signed")
    texts = signed.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("mark"),
        F.first("size").alias("size"), F.first("bands").alias("bands"))
    # The numbers are fixed by writing the table.
    texts = settle(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    members = shared_buckets(texts.select(F.explode("bands").alias("bucket"), "id"), texts.select("id", "size"))
    wanted = members.select("id").distinct().join(texts.select("id", "digest", "mark"), "id")
    sets = settle(_shingle_sets(docs, wanted), "sets")
    roots = _links(members, sets, threshold)
    texts = texts.select("id", "digest", "mark", "first").join(roots, "id", "left")
    return signed.select("doc_id", "digest"), settle(texts.withColumn("root", F.coalesce("root", "id")), "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_texts) of every row: the smallest doc_id and the number of different
    texts of its class."""
    rows, texts = _classes(docs, threshold)
    classes = texts.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    named = lookup_join(texts.select("digest", "root"), classes, "root").select("digest", "class_id", "n_texts")
    out = lookup_join(rows, named, "digest").select("doc_id", "class_id", "n_texts")
    alone = docs.where(F.col("text").isNull())
    return out.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_texts")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one of the smallest doc_id, with all its columns."""
    _, texts = _classes(docs, threshold)
    # A null doc_id comes last, so it only stays in a class of such.
    keep = texts.groupBy("root").agg(
        F.min(F.struct(F.col("first").isNull().alias("n"), "first", "digest", "mark")).alias("k"))
    keep = keep.select("k.digest", "k.mark")
    keyed = packed_rows(docs.where(F.col("text").isNotNull()), _digest(), _mark())
    kept = keyed.join(keep, ["digest", "mark"], "left_semi").dropDuplicates(["digest", "mark"])
    return unpacked_rows(kept, docs).unionByName(docs.where(F.col("text").isNull()))
