"""Scores of whole texts by a gated recurrent language model trained on the corpus.

Tokens are words between ASCII white space, A-Z in lower case, and one end for each text. A token
counts by its 64-bit hash. Exact counts over all training texts give the base score and the model's
vocabulary: the most frequent tokens, and for all others an id for their shape. A rarer token's
chance is that of its shape, from the network, times its smoothed share among the tokens of that
shape, so every token of the corpus has its part in the model.

Training: each task trains from the same parameters over every window of all its training texts, by
truncated backpropagation with the state carried on from a text's first to its last token; the tasks'
parameters are averaged by their tokens. So scores depend a little on how many tasks the table is read by.
Scoring: every text is read from its first to its last token with the state carried on.

Texts meet the counts of their tokens in blocks: a block of texts and the counts of its distinct
tokens come together in one task, so no table of all tokens is sent anywhere.

Null text: the empty text, which is an end only. Null doc_id: held out, as the empty text's checksum
is 0. Repeated rows each count in training and get equal scores. Further columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acctlens.llm import gru
from acctlens.llm.linking import free_shuffles
from acctlens.llm.textbytes import Texts, chunks, mixed
from acctlens.sources.tables import settle

SMOOTH = 0.1
END = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES = 12 << 20
# Rounds of training over all tokens and averaging, and texts that a task reads side by side.
ROUNDS = 1
SIDE = 64
SLICES = 64

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SHAPES = 24
END_SHAPE = SHAPES


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def shapes(t: Texts) -> np.ndarray:
    """The shape of each word: its last sign, its length, and whether it has other than ASCII."""
    last = t.data[t.word_ends - 1]
    sign = np.where(_ALPHA[last], 0, np.where(last == ord(","), 1, np.where(last == ord("."), 2, 3)))
    size = t.word_ends - t.word_starts
    wide = np.concatenate([[0], np.cumsum(t.data >= 128)])
    other = wide[t.word_ends] > wide[t.word_starts]
    return sign * 6 + np.minimum(2, (size > 4).astype(int) + (size > 9)) * 2 + other


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape) of all tokens of the texts, ends included, and where each text's begin."""
    starts = np.concatenate([[0], np.cumsum(t.n_words + 1)])
    value, shape = np.full(starts[-1], END), np.full(starts[-1], END_SHAPE)
    at = np.arange(len(t.word_hashes)) + t.word_text
    value[at], shape[at] = t.word_hashes, shapes(t)
    return value, shape, starts


def _blocked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), held_out().alias("held_out"))


def _with_block(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))


def _block_tokens(table: pa.Table) -> pa.Table:
    """The distinct tokens of a block with their shapes and their numbers in training texts."""
    kept = []
    batch = table.combine_chunks()
    held = batch.column("held_out").to_numpy()
    for i, j, t in chunks(batch.column("text").combine_chunks(), lower=True):
        value, shape, starts = tokens(t)
        trains = np.repeat(~held[i:j], np.diff(starts))
        distinct, first, which = np.unique(value, return_index=True, return_inverse=True)
        kept.append((distinct, shape[first], np.bincount(which, trains, len(distinct)).astype(np.int64)))
    value, shape, n = (np.concatenate(c) for c in zip(*kept))
    distinct, first, which = np.unique(value, return_index=True, return_inverse=True)
    counts = np.bincount(which, n, len(distinct)).astype(np.int64)
    block = pa.array(np.full(len(distinct), table.column("block")[0].as_py()), pa.int64())
    return pa.table([block, pa.array(distinct.view(np.int64)), pa.array(shape[first], pa.int32()), pa.array(counts)],
                    names=["block", "token", "shape", "n"])


class Vocabulary:
    """Ids of the frequent tokens by hash, and of the shapes; what the rest has by shape."""

    def __init__(self, top: list, by_shape: list):
        """``top``: (token, shape, c) of the most frequent; ``by_shape``: (shape, tokens, distinct) of all."""
        totals, distinct = np.zeros(SHAPES + 1), np.zeros(SHAPES + 1)
        for shape, total, many in by_shape:
            totals[shape], distinct[shape] = total, many
        self.all_tokens, self.all_distinct = float(totals.sum()), float(distinct.sum())
        words = [(c, t, s) for t, s, c in top if t != int(END.view(np.int64))][: gru.IDS - SHAPES - 1]
        for c, _, s in words:
            totals[s] -= c
            distinct[s] -= 1
        self.rest, self.rest_distinct = totals, distinct
        # Shapes come with what is left to them, the end with its own count.
        entries = [(totals[s], -1 - s) for s in range(SHAPES + 1)] + [(c, i) for i, (c, _, _) in enumerate(words)]
        entries.sort(key=lambda e: (-e[0], e[1]))
        self.counts = np.zeros(gru.IDS)
        self.shape_ids, ids = np.zeros(SHAPES + 1, np.int64), np.zeros(len(words), np.int64)
        for place, (c, i) in enumerate(entries):
            self.counts[place] = c
            if i < 0:
                self.shape_ids[-1 - i] = place
            else:
                ids[i] = place
        hashes = np.array([t for _, t, _ in words], np.int64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]

    def of(self, value: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of each token, whether it only has its shape's)."""
        out = self.shape_ids[shape]
        rare = shape != END_SHAPE
        if len(self.hashes):
            signed = value.view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, signed), len(self.hashes) - 1)
            known = self.hashes[at] == signed
            out = np.where(known, self.ids[at], out)
            rare &= ~known
        return out, rare

    @property
    def end(self) -> int:
        return int(self.shape_ids[END_SHAPE])


def _training(docs: DataFrame, flat: np.ndarray, words: Vocabulary, turn: int) -> DataFrame:
    """(part, slice, n, values): parameters of each task, in slices, times the tokens it saw."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = gru.Trainer(flat), 0
        for part in parts:
            for _, _, t in chunks(part.column("text"), lower=True):
                value, shape, starts = tokens(t)
                ids, _ = words.of(value, shape)
                trainer.texts(ids, starts, words.end, SIDE, turn)
                seen += len(value)
        if seen:
            cut = np.array_split(trainer.flat.astype(np.float64) * seen, SLICES)
            part = int(mixed(value[:1])[0] % np.uint64(1 << 20))
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()),
                pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "slice", "n", "values"])

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "part long, slice int, n long, values binary")


def _summed(table: pa.Table) -> pa.Table:
    values = sum(np.frombuffer(v.as_py()) for v in table.column("values"))
    n = int(np.sum(table.column("n").to_numpy()))
    part = table.column("part")[0].as_py() // 64
    return pa.table([[part], [table.column("slice")[0].as_py()], [n], [values.tobytes()]],
                    schema=pa.schema([("part", pa.int64()), ("slice", pa.int32()), ("n", pa.int64()), ("values", pa.binary())]))


def _averaged(models: DataFrame, flat: np.ndarray) -> np.ndarray:
    """The mean of the tasks' parameters, weighted by tokens, summed in groups and then in all."""
    schema = "part long, slice int, n long, values binary"
    sums = models.withColumn("part", F.pmod("part", F.lit(64))).groupBy("part", "slice").applyInArrow(_summed, schema)
    sums = sums.withColumn("part", F.lit(0).cast("long")).groupBy("slice").applyInArrow(_summed, schema)
    rows = sorted(sums.collect(), key=lambda r: r["slice"])
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(r["values"]) / r["n"] for r in rows]).astype(np.float32)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = _blocked(docs)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocked = _with_block(plain, 1 + size // BLOCK_BYTES)
    found = settle(blocked.groupBy("block").applyInArrow(_block_tokens, "block long, token long, shape int, n long"), "tokens")
    free_shuffles(found)
    counts = found.where("n > 0").groupBy("token").agg(F.min("shape").alias("shape"), F.sum("n").alias("c"))
    counts = settle(counts, "counts")
    # At most the size of the model's vocabulary, and one row for each shape.
    top = counts.orderBy(F.col("c").desc(), "token").limit(gru.IDS).collect()
    by_shape = counts.groupBy("shape").agg(F.sum("c"), F.count(F.lit(1))).collect()
    words = Vocabulary([tuple(r) for r in top], [tuple(r) for r in by_shape])
    flat = gru.initial(words.counts)
    for turn in range(rounds):
        flat = _averaged(settle(_training(plain, flat, words, turn), "models"), flat)
    known = settle(found.join(counts.select("token", "c"), "token").select("block", "token", "c"), "known")
    free_shuffles(known)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts, held = texts.combine_chunks(), texts.column("held_out")
        seen = known.column("token").to_numpy()
        order = np.argsort(seen)
        seen, c = seen[order], known.column("c").to_numpy()[order].astype(np.float64)
        n_tokens, n_known, base, read, rarity = [], [], [], [], []
        floor = np.log10(words.all_tokens + SMOOTH * (words.all_distinct + 1))
        rest = np.log(words.rest + SMOOTH * (words.rest_distinct + 1))
        for _, _, t in chunks(texts.column("text").combine_chunks(), lower=True):
            value, shape, starts = tokens(t)
            count = np.zeros(len(value))
            if len(seen):
                at = np.minimum(np.searchsorted(seen, value.view(np.int64)), len(seen) - 1)
                count = np.where(seen[at] == value.view(np.int64), c[at], 0.0)
            ids, rare = words.of(value, shape)
            within = np.where(rare, np.log(count + SMOOTH) - rest[shape], 0.0)
            n_tokens.append(np.diff(starts))
            n_known.append(t.per_text(count > 0, starts))
            base.append(np.add.reduceat(np.log10(count + SMOOTH) - floor, starts[:-1]))
            read.append(ids.astype(np.int32))
            rarity.append(np.add.reduceat(within, starts[:-1]))
        join = [np.concatenate(x) for x in (n_tokens, n_known, base, rarity)]
        # All texts of the block side by side: its longest text sets the number of steps once.
        starts = np.concatenate([[0], np.cumsum(join[0])])
        join[3] = (gru.score(flat, np.concatenate(read), starts, words.end) + join[3]) / np.log(10)
        total = np.full(len(texts), int(words.all_tokens))
        columns = [texts.column("doc_id"), held, pa.array(join[0].astype(np.int64)), pa.array(join[1].astype(np.int64)),
                   pa.array(total, pa.int64()), pa.array(join[2]), pa.array(join[3])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)
