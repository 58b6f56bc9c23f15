"""Toxicity of whole texts: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of 3 to 6 characters, in lower case, runs of white space as one space and one
space at both ends, each hashed to one of 2**20 bins. Of every bin the naive Bayes log-count ratio says how
much more of the toxic texts' n-grams fall on it than of the others'. The bins whose ratio is largest against its
standard error are the features; a feature that a text holds has the ratio as its value, and a logistic
regression with a quadratic penalty weighs the features. Counts, features and sets are made by Spark tasks; the
regression takes the features' places in the sampled texts.

Bounds: the fit reads a sample of ``SAMPLE`` labelled texts, those with the smallest hashes, and ``FEATURES``
bins. Texts are read whole, in fit and score. Labels count only if the checksum of their doc_id leaves a remainder
modulo 5; neither labels nor any column but the text enters a score.

A label is toxic if it is not 0; null labels, labels with a null doc_id and those without a document are not
used. A document with two labels is two examples; repeated rows are one. Null text: the empty text, which scores what
the classifier gives to no features. Null doc_id: held out, as the checksum of nothing is 0. Without labels of both
kinds all texts get the share of toxic labels, as one clean label more would give. Further columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acctlens.llm.textbytes import batches
from acctlens.sources.tables import settle

SIZES = (3, 4, 5, 6)
BIN_BITS = 20
SAMPLE = 8192
FEATURES = 8192
# Added to each bin's counts.
SMOOTH = 1.0
PENALTY = 1.0
# Characters, and texts, that are hashed at once; a longer text goes piece by piece.
PIECE, TEXTS = 1 << 18, 256
# Texts whose sets are held at once while fitting, in bytes.
BATCH_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, characters, characters to the end of the piece) of normalised texts, about PIECE at once.

    A long text gives several pieces, which overlap by what an n-gram needs.
    """
    step = PIECE - SIZES[-1] + 1
    owners, parts, many = [], [], 0
    for i, text in enumerate(texts):
        text = " " + " ".join((text or "").lower().split()) + " "
        for at in range(0, len(text), step):
            part = text[at : at + PIECE]
            if parts and (many + len(part) > PIECE or len(parts) == TEXTS):
                yield _piece(owners, parts)
                owners, parts, many = [], [], 0
            owners.append(i)
            parts.append(part)
            many += len(part)
    if parts:
        yield _piece(owners, parts)


def _piece(owners: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    signs = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(signs))
    return np.repeat(np.array(owners), sizes), signs, left


def bins(signs: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, their bins) of the n-grams of each size that lie in one piece."""
    value = np.zeros(len(signs), np.uint64)
    for k in range(SIZES[-1]):
        # Further signs count for the places that still have them.
        value *= FACTOR
        value[: max(0, len(signs) - k)] += signs[k:]
        value += np.uint64(1)
        if k + 1 in SIZES:
            at = np.flatnonzero(left > k)
            yield at, ((value[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _counts(examples: DataFrame) -> DataFrame:
    """(bin, toxic, clean): texts of each kind that hold an n-gram of the bin."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BIN_BITS), np.int64)
        for part in (b for p in parts for b in batches(p, "text", BATCH_BYTES)):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            seen = _sets(part.column("text").to_pylist())
            kinds = toxic[seen >> BIN_BITS]
            for kind in (False, True):
                total[int(kind)] += np.bincount(seen[kinds == kind] & ((1 << BIN_BITS) - 1), minlength=1 << BIN_BITS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1, some]), pa.array(total[0, some])], ["bin", "toxic", "clean"])

    held = examples.mapInArrow(run, "bin long, toxic long, clean long")
    return held.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _sets(texts: list[str | None], lookup: np.ndarray | None = None) -> np.ndarray:
    """Distinct (text << BIN_BITS | bin), sorted; with a ``lookup``, of the bins it has a place for, as that place."""
    out = [np.zeros(0, np.int64)]
    for owner, signs, left in pieces(texts):
        if lookup is None:
            out.append(np.unique(np.concatenate([owner[at] << BIN_BITS | value for at, value in bins(signs, left)])))
            continue
        held = np.zeros(TEXTS * FEATURES, bool)
        for at, value in bins(signs, left):
            place = lookup[value]
            kept = np.flatnonzero(place >= 0)
            held[(owner[at[kept]] - owner[0]) * FEATURES + place[kept]] = True
        held = np.flatnonzero(held)
        out.append(held // FEATURES + owner[0] << BIN_BITS | held % FEATURES)
    return np.unique(np.concatenate(out))


@dataclass(frozen=True)
class Classifier:
    """Bins that are features, the weight of each times its ratio, and what no features score."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        out = np.full(1 << BIN_BITS, -1, np.int64)
        out[self.bins] = np.arange(len(self.bins))
        return out

    def scores(self, texts: list[str | None], lookup: np.ndarray) -> np.ndarray:
        held = _sets(texts, lookup)
        total = np.bincount(held >> BIN_BITS, self.weights[held & ((1 << BIN_BITS) - 1)], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> tuple[np.ndarray, float]:
    """(weights, bias) of a penalised logistic regression by L-BFGS; entry (row, column) has the value of its column's scale.

    Both kinds of labels weigh the same in all, so that one half is where they are parted.
    """
    n, many = len(labels), len(scale)
    weight = np.where(labels, n / (2 * labels.sum()), n / (2 * (~labels).sum()))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        x = np.bincount(rows, (w[:-1] * scale)[columns], n) + w[-1]
        signed = np.where(labels, x, -x)
        p = 1 / (1 + np.exp(np.clip(signed, -700, 700)))
        pull = np.where(labels, -p, p) * weight
        grad = np.append(np.bincount(columns, pull[rows], many) * scale + penalty * w[:-1], pull.sum())
        return float((weight * np.logaddexp(0, -signed)).sum() + penalty / 2 * (w[:-1] @ w[:-1])), grad

    w, past = np.zeros(many + 1), []
    value, grad = loss(w)
    for _ in range(steps):
        way, coefficients = grad.copy(), []
        for s, y in reversed(past):
            coefficients.append((s @ way) / (s @ y))
            way -= coefficients[-1] * y
        if past:
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            way /= max(1.0, float(np.sqrt(way @ way)))
        for (s, y), a in zip(past, reversed(coefficients)):
            way += (a - (y @ way) / (s @ y)) * s
        size = 1.0
        while size > 1e-10:
            new_value, new_grad = loss(w - size * way)
            if new_value <= value - 1e-4 * size * (grad @ way):
                break
            size /= 2
        else:
            break
        step, change = -size * way, new_grad - grad
        gain, w, value, grad = value - new_value, w + step, new_value, new_grad
        if step @ change > 1e-12:
            past = [*past[-9:], (step, change)]
        if gain < 1e-7 * max(1.0, value):
            break
    return w[:-1], float(w[-1])


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of the sampled labelled documents that are learnt from, as a written table."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    named = named.select("doc_id", (F.col("toxic") != 0).alias("toxic")).distinct()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.where(~held_out()).select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    pairs = keyed.select("doc_id", "mark").distinct().join(named, "doc_id")
    chosen = settle(pairs.orderBy(F.xxhash64("doc_id", "mark", "toxic"), "doc_id", "mark", "toxic").limit(sample), "chosen")
    # The broadcast holds the sample's ids only.
    found = keyed.join(F.broadcast(chosen), ["doc_id", "mark"])
    return settle(found.groupBy("doc_id", "mark", "toxic").agg(F.first("text").alias("text")).select("toxic", "text"), "examples")


def _with_ratios(counts: DataFrame, smooth: float) -> DataFrame:
    """Adds each bin's log-count ratio, and how surely it is not zero."""
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n")).first()
    norm = np.log((sums["toxic"] + smooth * sums["n"]) / (sums["clean"] + smooth * sums["n"]))
    toxic, clean = F.col("toxic") + smooth, F.col("clean") + smooth
    ratio = F.log(toxic / clean) - float(norm)
    return counts.select("bin", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / toxic + 1 / clean)).alias("sure"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    known = examples(docs, labels, sample)
    kinds = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        toxic = kinds.get(True, 0)
        share = toxic / (sum(kinds.values()) + 1)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))) if share else -700.0)
    counts = settle(_counts(known), "ngrams")
    best = _with_ratios(counts, SMOOTH).orderBy(F.col("sure").desc(), "bin").limit(FEATURES).collect()
    chosen, ratios = np.array([r["bin"] for r in best]), np.array([r["ratio"] for r in best])
    lookup = Classifier(chosen, ratios, 0.0).lookup()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in batches(p, "text", BATCH_BYTES)):
            held = _sets(part.column("text").to_pylist(), lookup)
            ends = np.searchsorted(held >> BIN_BITS, np.arange(len(part) + 1)).astype(np.int32)
            places = pa.array((held & ((1 << BIN_BITS) - 1)).astype(np.int16))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.ListArray.from_arrays(ends, places)], ["toxic", "places"])

    rows = known.mapInArrow(run, "toxic boolean, places array<short>").collect()
    sizes = [len(r["places"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.fromiter((p for r in rows for p in r["places"]), np.int64, sum(sizes))
    weights, bias = logistic(row, place, ratios, np.array([r["toxic"] for r in rows]))
    return Classifier(chosen, weights * ratios, bias)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = train(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for part in parts:
            score = model.scores(part.column("text").to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
