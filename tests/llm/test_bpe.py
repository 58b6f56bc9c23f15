import hashlib
import random

import pytest
from tokenizers import Tokenizer

from acctlens.llm import bpe
from acctlens.llm.queries import TOKENIZER, op1_bpe

PARTS = list("abcdefgzéüßñÉABCΣσ \n\t'’stm0123٣九ſİ!?#<|>·\x1c\x85\xa0　​😀한") + [
    "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "the ", "aaaa", "́"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(TOKENIZER)


def test_same_as_the_library(library, own):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_batch(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert list(bpe.unpacked(ids)) == wanted, text
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 9, 16, 17, 33, 700])
def test_segment_tree_against_a_scan(own, size):
    rnd = random.Random(size)
    for _ in range(20):
        symbols = [own.inner[ord(rnd.choice("aeinrst"))] for _ in range(size)]
        wanted = list(symbols)
        while True:
            ranked = [(own.ranks[k][0], i) for i in range(len(wanted) - 1) if (k := wanted[i] * own.width + wanted[i + 1]) in own.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            wanted[i : i + 2] = [own.ranks[wanted[i] * own.width + wanted[i + 1]][1]]
        assert bpe.merge_symbols(list(symbols), own.ranks, own.width) == wanted


def test_long_word_and_restarted_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 5)
    own = bpe.WordBpe(TOKENIZER)
    texts = ["ab" * 30_000, "some more words here and there", "other words", "some more words"]
    for text in texts:
        assert list(bpe.unpacked(own.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, sf_dir, library):
    rows = op1_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(bpe.packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(docs, odd_rows, library):
    out = bpe.encode_texts(docs(odd_rows), TOKENIZER).collect()
    wanted = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in odd_rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in out), key=repr) == sorted(wanted, key=repr)
    assert bpe.encode_digests(docs([]), TOKENIZER).count() == 0
