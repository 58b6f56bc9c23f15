"""Texts that hashes modulo a power of two take for equal: as words, lines and pieces they differ."""

import numpy as np
import pyarrow as pa
import pytest
from acctlens.llm import lm_scoring, near_dedup, quality_rules
from acctlens.llm.bpe import WordBpe
from acctlens.llm.queries import TOKENIZER
from acctlens.llm.textbytes import FIELDS, SUMMED, chunks, span_hashes
from tokenizers import Tokenizer


def morse(n):
    """The Thue-Morse word of n letters and its complement."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(*texts):
    [(_, _, t)] = chunks(pa.array(texts))
    return t.word_hashes


def plain(values):
    """The two polynomials of a whole text, with Python's own numbers."""
    return [sum(v * pow(base, i, prime) for i, v in enumerate(values)) % prime for prime, base in FIELDS]


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_lines_and_pieces(n, docs):
    a, b = morse(n)
    assert len(set(hashes(a, b, a).tolist())) == 2
    [(_, _, t)] = chunks(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))
    assert quality_rules.dup_lines(t).tolist() == [0, 1]
    own, library = WordBpe(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    for got, text in zip(own.encode_batch([a, b, f"{b} {a}"]), [a, b, f"{b} {a}"]):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shingles_and_tokens_of_such_words():
    a, b = morse(2048)
    [(_, _, t)] = chunks(pa.array([f"{a} is one of two", f"{b} is one of two"]))
    owner, value = near_dedup.shingles(t)
    assert len(set(value.tolist())) == 2
    value, _, starts = lm_scoring.tokens(t)
    assert value[0] != value[starts[1]]


@pytest.mark.parametrize("n", [1, 5, SUMMED - 1, SUMMED, SUMMED + 1, 3 * SUMMED + 17])
def test_spans_wherever_they_are(n):
    random = np.random.default_rng(n)
    for top in (250, 1 << 21):
        values = random.integers(1, top, n).astype(np.uint64)
        twice = np.concatenate([random.integers(1, top, 7).astype(np.uint64), values, values])
        x, y = span_hashes(twice, np.array([7, 7 + n]), np.array([7 + n, 7 + 2 * n]))
        assert x == y == span_hashes(values, np.array([0]), np.array([n]))[0]
        values[n // 2] += 1
        assert x != span_hashes(values, np.array([0]), np.array([n]))[0]


def test_against_plain_polynomials():
    from acctlens.llm.textbytes import mixed

    values = [5, 7, 1 << 20, 3]
    p, q = plain(values)
    want = mixed(np.array([p | q << 32], np.uint64) ^ mixed(np.array([4], np.uint64)))
    assert span_hashes(np.array(values, np.uint64), np.array([0]), np.array([4])) == want
