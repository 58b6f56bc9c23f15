"""Words, lines and their hashes over whole Arrow string columns at once.

Texts are cut into chunks of bounded size, and a chunk is treated as one byte array with the
documents' boundaries beside it. A single text longer than the bound is a chunk of its own.
White space is ASCII: space and the characters 9 to 13. A hash has 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
# Two primes and a base for each. Modulo a power of two, repetitive texts could have equal hashes.
FIELDS = ((2147483647, 1581746423), (2147483629, 1040683627))
# Products that are summed up before they are reduced: 2 ** 16 of less than 2 ** 47 each.
SUMMED = 1 << 16

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: all output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime. Kept up to the chunk size."""
    have = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        if len(have) <= 2 * CHUNK_BYTES:
            _POWERS[base, prime] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Sums of value * base ** place over the places before each, modulo the prime but for some multiple of it."""
    n = len(values)
    terms = values * powers(base, prime, n)
    if n and values.max() >= 1 << 16:
        terms %= np.uint64(prime)
    width = min(SUMMED, n) or 1
    rows = np.zeros((-(-n // width), width), np.uint64)
    rows.ravel()[:n] = terms
    np.cumsum(rows, axis=1, out=rows)
    before = np.cumsum(rows[:, -1] % np.uint64(prime))
    rows[1:] += before[:-1, None]
    return np.concatenate([np.zeros(1, np.uint64), rows.ravel()[:n]])


def span_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values (unsigned, not 0) from each begin to its end, wherever they are.

    Polynomials modulo two primes, read off prefix sums: 62 bits tell texts apart, of whatever pattern.
    """
    parts = []
    for prime, base in FIELDS:
        p = np.uint64(prime)
        sums = _prefix(values, base, prime)
        part = (sums[ends] % p + p - sums[begins] % p) % p
        parts.append(part * powers(pow(base, -1, prime), prime, len(values) + 1)[begins] % p)
    return mixed((parts[0] | parts[1] << np.uint64(32)) ^ mixed((ends - begins).astype(np.uint64)))


def spans_covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the length beginning at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


class Texts:
    """Some whole texts as one byte array. ``starts`` has one entry more than there are texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = False):
        self.raw, self.starts = data, starts
        self.data = LOWER[data] if lower else data
        self.n = len(starts) - 1

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~IS_SPACE[self.data]
        first = np.zeros(len(inside) + 1, bool)
        first[self.starts] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def word_starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._words[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """The words of text i are word_bounds[i] to word_bounds[i + 1]."""
        return np.searchsorted(self.word_starts, self.starts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each begin to its end: equal bytes, equal hash, wherever they are."""
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), begins, ends)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.word_starts, self.word_ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words that lies in one text."""
        words, n = self.word_hashes, len(self.word_hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            value *= np.uint64(0xD6E8FEB86659FD93)
            value += words[k : n - size + 1 + k]
        same = self.word_text[size - 1 :] == self.word_text[: n - size + 1]
        first = np.flatnonzero(same)
        return first, mixed(value[first])

    def take(self, chosen: np.ndarray) -> Texts:
        """The chosen texts (a mask), with what is already known about their words."""
        sizes = np.diff(self.starts)[chosen]
        out = Texts(self.data[np.repeat(chosen, np.diff(self.starts))], np.concatenate([[0], np.cumsum(sizes)]))
        if "_words" in self.__dict__:
            keep = chosen[self.word_text]
            shift = np.repeat(out.starts[:-1] - self.starts[:-1][chosen], self.n_words[chosen])
            out._words = self.word_starts[keep] + shift, self.word_ends[keep] + shift
            if "word_hashes" in self.__dict__:
                out.word_hashes = self.word_hashes[keep]
        return out

    def per_text(self, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the flags of each text; ``at``: where each text's flags begin, with the end."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, end) of each line between line feeds."""
        feeds = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.starts, feeds, side="right") - 1
        begins = np.concatenate([self.starts[:-1], feeds + 1])
        ends = np.concatenate([feeds, self.starts[1:]])
        texts = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((begins, texts))
        last = np.lexsort((ends, np.concatenate([owner, np.arange(self.n)])))
        return texts[order], begins[order], ends[last]


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, texts) over the rows of a string column, null as empty, nothing left out."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, Texts(data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64), lower)
        i = j


def batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts together stay under the limit, or hold one text."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
