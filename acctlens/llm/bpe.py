"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as one symbol per byte, the last one with the word-end mark. The tree's leaves hold
the merge rank of the pair that begins at each symbol, and every inner node the smallest of its two
children, the left one on a tie. So the root names the leftmost pair of the lowest rank. After a
merge three leaves change, each in logarithmic time, until no mergeable pair is left.

Texts are taken whole. Null text: encoded as the empty text, which has no ids. Repeated rows are
encoded alike; ids and text of a row depend on its text alone. Other columns are not read.
A special token written out in a text becomes its id, as the tokenizer file asks for.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from sys import byteorder

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from acctlens.llm.textbytes import CHUNK_BYTES, batches, span_hashes

# Distinct pieces of text whose ids a Python worker keeps; beyond that it starts anew.
KNOWN_PIECES = 1_500_000

# Fixed values of the tokenizer file: its white space and the endings taken with an apostrophe.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
OTHER, LETTER, DIGIT, SPACE = range(4)
NO_PAIR = 1 << 60


@lru_cache(maxsize=1)
def _character_kinds() -> np.ndarray:
    """Letter, digit, white space or other for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, every))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
        for found in regex.finditer(pattern, text):
            kinds[ord(text[found.start()]) : ord(text[found.end() - 1]) + 1] = kind
    return kinds


def _normal(text: str) -> str:
    """Composed, and in lower case character by character (so a capital sigma whatever follows)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def merge_symbols(symbols: list[int], ranks: dict[int, tuple[int, int]], width: int) -> list[int]:
    """The ids left when no adjacent pair has a rank. ``ranks``: left * width + right -> (rank, id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    # A leaf's value is rank * size + place: the smallest one is the leftmost of the lowest rank.
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        found = get(symbols[i] * width + symbols[i + 1])
        if found:
            tree[size + i] = found[0] * size + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] < NO_PAIR:
        i = tree[1] & (size - 1)
        j = after[i]
        symbols[i] = get(symbols[i] * width + symbols[j])[1]
        k = after[i] = after[j]
        symbols[j] = -1
        if k < n:
            before[k] = i
        h = before[i]
        for left, right in ((j, n), (i, k), (h, i)):
            if left < 0 or left >= n - 1:
                continue
            value = NO_PAIR
            if right < n:
                found = get(symbols[left] * width + symbols[right])
                if found:
                    value = found[0] * size + left
            at = size + left
            if tree[at] == value:
                continue
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                value = a if a < b else b
                if tree[at] == value:
                    break
                tree[at] = value
                at >>= 1
    return [s for s in symbols if s >= 0]


class Merges:
    """The same merging for many words of one size class at once, a row of arrays for each word."""

    def __init__(self, ranks: dict[int, tuple[int, int]], width: int):
        keys = np.array(list(ranks), np.int64)
        values = np.array(list(ranks.values()), np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], values[order, 0]
        self.merged = np.zeros(len(keys), np.int64)
        self.merged[values[:, 0]] = values[:, 1]
        self.width = width

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where it can't be merged."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NO_PAIR)

    def run(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row; absent and used up symbols are -1. The row length is a power of two."""
        rows, size = symbols.shape
        shift = size.bit_length() - 1
        place = np.arange(size, dtype=np.int64)
        # One more column at the end takes the writes that go past a word.
        sym = np.full((rows, size + 1), -1, np.int64)
        sym[:, :size] = symbols
        tree = np.full((rows, 2 * size), NO_PAIR, np.int64)
        rank = self.ranks(sym[:, :size], sym[:, 1:])
        tree[:, size:] = np.where(rank < NO_PAIR, (rank << shift) + place, NO_PAIR)
        low = size
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        after = np.tile(np.append(place + 1, size), (rows, 1)).ravel()
        before = np.tile(np.append(place - 1, size - 1), (rows, 1)).ravel()
        flat, nodes = sym.ravel(), tree.ravel()
        left = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(left):
            at, top = left * (size + 1), left * 2 * size
            root = nodes[top + 1]
            i = root & (size - 1)
            j = after[at + i]
            k = after[at + j]
            flat[at + i] = joined = self.merged[root >> shift]
            flat[at + j] = -1
            after[at + i] = k
            before[at + k] = i
            h = before[at + i]
            nodes[top + size + j] = NO_PAIR
            rank = self.ranks(joined, flat[at + k])
            nodes[top + size + i] = np.where(rank < NO_PAIR, (rank << shift) + i, NO_PAIR)
            has = h >= 0
            rank = self.ranks(np.where(has, flat[at + np.maximum(h, 0)], -1), joined)
            h = np.where(has, h, i)
            nodes[top + size + h] = np.where(
                has, np.where(rank < NO_PAIR, (rank << shift) + h, NO_PAIR), nodes[top + size + h])
            for leaf in (j, i, h):
                node = leaf + size
                for _ in range(shift):
                    node = node >> 1
                    child = top + 2 * node
                    nodes[top + node] = np.minimum(nodes[child], nodes[child + 1])
            left = left[nodes[top + 1] < NO_PAIR]
        return sym[:, :size]


class KnownPieces:
    """Ids by piece hash, in sorted arrays over one pool of ids."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.begins, self.sizes, self.pool = (np.zeros(0, np.int64) for _ in range(3))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        begins = np.cumsum(sizes) - sizes + len(self.pool)
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged)
        self.hashes = merged[order]
        self.begins = np.concatenate([self.begins, begins])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.pool = np.concatenate([self.pool, ids])


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each size in turn."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - ends + sizes, sizes)


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        end = model["end_of_word_suffix"]
        self.width = max(self.tokens) + 1
        self.ranks = {}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            self.ranks[self.vocab[a] * self.width + self.vocab[b]] = (rank, self.vocab[a + b])
        self.inner = [self.vocab[s] for s in byte_symbols()]
        self.final = [self.vocab[s + end] for s in byte_symbols()]
        self.inner_ids, self.final_ids = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.merges = Merges(self.ranks, self.width)
        self.known = KnownPieces()
        self.kind = _character_kinds()

    def _segments(self, text: str) -> list[str | int]:
        """Normalised texts, and ids of the special tokens between them."""
        out: list[str | int] = []
        at = 0
        for found in self.special.finditer(text) if "<|" in text else ():
            out += [_normal(text[at : found.start()]), self.specials[found[0]]]
            at = found.end()
        return [*out, _normal(text[at:])]

    def _cut(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the pieces among code points.

        A piece is a run of letters, one digit, or a run of other characters; white space parts
        them. An apostrophe alone before one of the fixed endings takes the ending along.
        """
        kind = self.kind[code]
        begins = kind != SPACE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        ahead = np.concatenate([code, np.zeros(3, code.dtype)])
        mark = np.flatnonzero(begins & (code == ord("'")))
        for ending in ENDINGS:
            hit = mark[np.all([ahead[mark + 1 + i] == ord(c) for i, c in enumerate(ending)], axis=0)]
            begins[hit + 1] = False
            beyond = hit + 1 + len(ending)
            beyond = beyond[beyond < len(code)]
            begins[beyond] = kind[beyond] != SPACE
        begin = np.flatnonzero(begins)
        stop = np.append(kind[1:] == SPACE, True) & (kind != SPACE)
        # A piece ends where the next begins or where white space follows.
        follows = np.append(begins[1:], False) & (kind != SPACE)
        return begin, np.flatnonzero(stop | follows) + 1

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all their ids): by size class together, long ones alone."""
        data = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in data], np.int64)
        counts, parts, owners = np.zeros(len(pieces), np.int64), [], []
        low = 0
        for size in (8, 16, 32):
            of = np.flatnonzero((sizes > low) & (sizes <= size))
            for some in np.split(of, range(20_000, len(of), 20_000)):
                if not len(some):
                    continue
                flat = np.frombuffer(b"".join([data[i] for i in some]), np.uint8)
                inside = np.arange(size) < sizes[some][:, None]
                symbols = np.full((len(some), size), -1, np.int64)
                symbols[inside] = self.inner_ids[flat]
                symbols[np.arange(len(some)), sizes[some] - 1] = self.final_ids[flat[np.cumsum(sizes[some]) - 1]]
                ids = self.merges.run(symbols)
                counts[some] = (ids >= 0).sum(axis=1)
                parts.append(ids[ids >= 0])
                owners.append(some)
            low = size
        for i in np.flatnonzero(sizes > low):
            ids = merge_symbols(
                [*(self.inner[b] for b in data[i][:-1]), self.final[data[i][-1]]], self.ranks, self.width)
            counts[i] = len(ids)
            parts.append(np.array(ids, np.int64))
            owners.append(np.array([i]))
        if not parts:
            return counts, np.zeros(0, np.int64)
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        begins = np.zeros(len(pieces), np.int64)
        begins[owner] = np.cumsum(counts[owner]) - counts[owner]
        return counts, flat[runs(begins, counts)]

    def _encode_segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, where each text's ids end)."""
        whole = "\n".join(texts)
        # Like a byte's, a character's value in the hash is taken one higher.
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begin, end = self._cut(code)
        value = span_hashes(code.astype(np.uint64) + np.uint64(1), begin, end)
        distinct, first, which = np.unique(value, return_index=True, return_inverse=True)
        if len(self.known.hashes) > KNOWN_PIECES:
            self.known = KnownPieces()
        _, found = self.known.find(distinct)
        new = np.flatnonzero(~found)
        if len(new):
            at = first[new]
            pieces = [whole[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist())]
            self.known.add(distinct[new], *self._encode_pieces(pieces))
        at, _ = self.known.find(distinct)
        sizes = self.known.sizes[at][which]
        ids = self.known.pool[runs(self.known.begins[at][which], sizes)]
        lengths = np.array([len(t) + 1 for t in texts])
        upto = np.searchsorted(begin, np.cumsum(lengths) - 1)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[upto]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        segments = [self._segments(t or "") for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        todo: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            ids, ends = self._encode_segments([s for _, s in todo])
            data, begin = ids.astype("<u4").tobytes(), 0
            for (owner, _), end in zip(todo, (4 * ends).tolist()):
                out[owner].append(data[begin:end])
                begin = end
            todo.clear()

        for i, parts in enumerate(segments):
            for part in parts:
                if isinstance(part, int):
                    flush()
                    out[i].append(packed([part]))
                    size = 0
                    continue
                todo.append((i, part))
                size += len(part)
                if size > CHUNK_BYTES:
                    flush()
                    size = 0
        if todo:
            flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids joined by a space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, unpacked(ids)))


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(data: bytes) -> array:
    out = array("I")
    out.frombytes(data)
    if byteorder == "big":
        out.byteswap()
    return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in parts:
            for part in batches(whole, "text"):
                codes = bpe.encode_batch(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array([unpacked(c) for c in codes], pa.list_(pa.int32())), pa.array([bpe.decode(c) for c in codes])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As :func:`encode_texts`, with digests in place of the ids and the decoded text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in parts:
            for part in batches(whole, "text"):
                rows = []
                for ids in bpe.encode_batch(part.column("text").to_pylist()):
                    decoded = bpe.decode(ids).encode()
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
