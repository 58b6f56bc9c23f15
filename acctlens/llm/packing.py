"""Best-fit decreasing packing of token pieces into sequences.

Pieces of equal length are interchangeable, so the packing is planned on the number of pieces of
each length, which is at most ``max_len`` numbers however many documents there are. Lengths go from
long to short; a segment tree over the remaining capacities names the tightest open sequence that
still fits, and all pieces that the best-fit rule would place alike are placed by one step. The plan
is a list of runs (length, first rank, first sequence, offset), at most a few for each pair of
lengths that share a sequence. Pieces take their rank within their length in a distributed way and
look up their run.

Null text: no tokens but the end token. Every row is packed, repeated ones too. Texts longer than a
sequence are cut into full sequences and a rest; nothing else is cut. Further columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctlens.llm.bpe import load, packed
from acctlens.llm.ranks import numbered
from acctlens.llm.textbytes import batches
from acctlens.sources.tables import settle

MAX_LEN = 4096
END_ID = 1


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree finds the tightest in logarithmic time."""

    def __init__(self, max_len: int):
        self.size = 1 << max_len.bit_length()
        self.some = [False] * (2 * self.size)
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, room: int, first: int, count: int) -> None:
        """``count`` sequences from ``first`` on have ``room`` left."""
        if not count or not room:
            return
        self.by_room[room].append((first, count))
        self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        out = self.by_room[room].pop()
        self._mark(room)
        return out

    def _mark(self, room: int) -> None:
        at = self.size + room
        self.some[at] = bool(self.by_room[room])
        at >>= 1
        while at:
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open sequence has."""
        at = self.size + length
        if self.some[at]:
            return length
        while at > 1:
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan_packing(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) of a best-fit decreasing packing."""
    runs, opened, bins = [], OpenSequences(max_len), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = opened.tightest(length)
            if room is None:
                room, first = max_len, bins
                have = -(-left // (max_len // length))
                bins += have
            else:
                first, have = opened.pop(room)
            # A sequence that took a piece is now tighter, so it takes more until it is full.
            each = room // length
            full, rest = divmod(min(left, each * have), each)
            for filled, begin, took in ((full, first, each), (1 if rest else 0, first + full, rest)):
                for k in range(took if filled else 0):
                    runs.append((length, rank, filled, begin, max_len - room + k * length))
                    rank += filled
                    left -= filled
                opened.add(room - took * length, begin, filled)
            used = full + (1 if rest else 0)
            opened.add(room, first + used, have - used)
    return runs


def token_pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids with the end token."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end, step = packed([END_ID]), 4 * max_len
    names = ["piece", "start", "length", "ids_crc32"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in parts:
            for part in batches(whole, "text"):
                owner, rows = [], []
                for i, ids in enumerate(bpe.encode_batch(part.column("text").to_pylist())):
                    data = ids + end
                    for k, at in enumerate(range(0, len(data), step)):
                        some = data[at : at + step]
                        owner.append(i)
                        rows.append((k, at // 4, len(some) // 4, zlib.crc32(some)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                ids = part.column("doc_id").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """``pieces`` (a written table with a ``length``) with ``sequence_id`` and ``offset`` added."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan_packing(counts, max_len)), np.int64).reshape(-1, 5)
    rank_bits = 48
    keys, given = (runs[:, 0] << rank_bits) + runs[:, 1], pieces.columns
    ranked = numbered(pieces, "length", [c for c in given if c != "length"], "_rank")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rank = part.column("_rank").to_numpy()
            length = part.column("length").to_numpy()
            at = np.searchsorted(keys, (length << rank_bits) + rank, side="right") - 1
            columns = [part.column(c) for c in given]
            columns += [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*given, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    """All documents' pieces with their sequence and place there."""
    return pack_pieces(settle(token_pieces(docs, path, max_len), "pieces"), max_len)
