"""Quality rules as a short-circuit cascade.

A rule rejects texts; a text is kept if no rule rejects it. The verdict does not depend on the
order of the rules, only the work does: on a bounded sample each rule's cost and its share of
rejections are measured, and rules run by rejections per second, each on the texts that those
before it have left. Texts are handled whole, in byte arrays of many texts at a time.

Null text: treated as empty, so it has no words and is rejected. White space is ASCII only.
Repeated rows get equal verdicts. Further columns of the input pass through ``keep_good``; only
``doc_id`` and ``text`` are read by ``quality_report``. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acctlens.llm.textbytes import Texts, chunks, spans_covered

# Fixed values of the contract: symbols, window, and the two bounds of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SAMPLE_ROWS = 500
SAMPLE_BYTES = 200_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_WORDY = _LETTER.copy()
_WORDY[128:] = True


def word_chars(t: Texts) -> np.ndarray:
    """Code points within words."""
    size = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)])
    return t.per_text(size[t.word_ends] - size[t.word_starts], t.word_bounds)


def symbols(t: Texts) -> np.ndarray:
    return t.per_text(_SYMBOL[t.data], t.starts)


def _worded_lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, begins, ends = t.lines()
    worded = np.searchsorted(t.word_starts, ends) > np.searchsorted(t.word_starts, begins)
    return owner[worded], begins[worded], ends[worded]


def lines_with_words(t: Texts) -> np.ndarray:
    return np.bincount(_worded_lines(t)[0], minlength=t.n)


def dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of the text."""
    owner, begins, ends = _worded_lines(t)
    value = t.hashes(begins, ends)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    again = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    return np.bincount(owner[1:][again], minlength=t.n)


def repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of eight words that occur twice or more in the text."""
    first, value = t.windows(WINDOW)
    owner = t.word_text[first]
    order = np.lexsort((value, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    found = np.zeros(len(first), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return t.per_text(spans_covered(first[found], WINDOW, len(t.word_starts)), t.word_bounds)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _word_length(t: Texts) -> np.ndarray:
    chars = word_chars(t)
    return (chars < 2 * t.n_words) | (chars > 25 * t.n_words)


def _few_letters(t: Texts) -> np.ndarray:
    wordy = np.concatenate([[0], np.cumsum(_WORDY[t.data], dtype=np.int64)])
    with_letter = t.per_text(wordy[t.word_ends] > wordy[t.word_starts], t.word_bounds)
    return 10 * with_letter < 6 * t.n_words


def _shouted(t: Texts) -> np.ndarray:
    return 10 * t.per_text(_UPPER[t.data], t.starts) > 6 * t.per_text(_LETTER[t.data], t.starts)


BASE_RULES = [
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated_words", lambda t: 100 * repeat_words(t) > MAX_REPEAT_PERCENT * t.n_words),
]
MORE_RULES = [
    Rule("symbols", lambda t: 10 * symbols(t) > t.n_words),
    Rule("repeated_lines", lambda t: 10 * dup_lines(t) > 6 * lines_with_words(t)),
    Rule("word_length", _word_length),
    Rule("few_letters", _few_letters),
    Rule("upper_case", _shouted),
]
RULES = BASE_RULES + MORE_RULES


def plan_cascade(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, measured on a bounded sample.

    The sample has at most ``rows`` texts of at most ``SAMPLE_BYTES`` bytes each; it decides the
    order only. Ties and an empty sample leave the given order.
    """
    sample = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").take(rows)
    column = pa.array([r["text"] for r in sample], pa.string())
    cost, hits = dict.fromkeys((r.name for r in rules), 1e-9), dict.fromkeys((r.name for r in rules), 0)
    for _, _, texts in chunks(column):
        texts.word_hashes  # shared by the rules, so no rule's cost
        for rule in rules:
            began = time.perf_counter()
            hits[rule.name] += int(rule.rejects(texts).sum())
            cost[rule.name] += time.perf_counter() - began
    return sorted(rules, key=lambda r: -hits[r.name] / cost[r.name])


def passes(texts: Texts, rules: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the texts alive pass all rules; a rule sees only what is left."""
    alive = alive.copy()
    left = texts if alive.all() else texts.take(alive)
    for rule in rules:
        if not left.n:
            break
        good = ~rule.rejects(left)
        if not good.all():
            alive[np.flatnonzero(alive)[~good]] = False
            left = left.take(good)
    return alive


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text no rule rejects."""
    ordered = plan_cascade(docs, RULES if rules is None else rules)

    def select(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            mask = [passes(t, ordered, np.ones(t.n, bool)) for _, _, t in chunks(part.column("text"))]
            if mask:
                yield part.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(select, docs.schema)


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document the base counts and the verdict.

    The base counts are wanted for every document, so the base rules cost nothing more and come
    first; the cascade orders the other rules.
    """
    ordered = plan_cascade(docs, MORE_RULES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def report(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, j, t in chunks(part.column("text")):
                counts = [t.n_words, word_chars(t), symbols(t), dup_lines(t), repeat_words(t)]
                failed = base_failed(counts[0], counts[4])
                columns = [part.column("doc_id").slice(i, j - i), *[pa.array(c, pa.int64()) for c in counts]]
                columns += [pa.array(failed), pa.array(passes(t, ordered, ~failed))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept"])

    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(report, schema)
