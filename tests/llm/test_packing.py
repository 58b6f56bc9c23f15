import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from acctlens.llm import packing
from acctlens.llm.bpe import packed
from acctlens.llm.queries import TOKENIZER


def best_fit(sizes, room):
    """The rule written out: longest first, each into the tightest open sequence."""
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= s]
        if fits:
            i = min(fits, key=lambda i: left[i])
            left[i] -= s
        else:
            left.append(room - s)
    return sorted(left)


def gapless(places, room):
    out = []
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= room
        out.append(room - at)
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    room = rnd.choice([10, 17, 64, 100])
    sizes = [rnd.randint(1, room) for _ in range(rnd.randint(1, 300))]
    places, placed = defaultdict(list), Counter()
    for length, rank, n, first, offset in packing.plan_packing(Counter(sizes), room):
        assert rank == placed[length]
        placed[length] += n
        for i in range(n):
            places[first + i].append((offset, length))
    assert placed == Counter(sizes)
    assert gapless(places, room) == best_fit(sizes, room)


def check(rows, pairs, room):
    library = Tokenizer.from_file(TOKENIZER)
    wanted = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), room)):
            wanted.append((i, k, at, len(ids[at : at + room]), zlib.crc32(packed(ids[at : at + room]))))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(wanted, key=repr)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert gapless(places, room) == best_fit([w[3] for w in wanted], room)


def test_documents(documents):
    rows = packing.pack_documents(documents, TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 4096)


def test_odd_rows(docs, odd_rows):
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check(packing.pack_documents(docs(odd_rows), TOKENIZER, 100).select(*order).collect(), odd_rows, 100)
    assert packing.pack_documents(docs([]), TOKENIZER).count() == 0
