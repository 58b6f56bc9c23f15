import numpy as np
import pyarrow as pa

from acctlens.llm import near_dedup as nd
from acctlens.llm.textbytes import chunks


def test_repeated_passages_share_a_band():
    """Equal sets of shingles, and a Jaccard similarity of 0.83, whatever is repeated 20 to 100 times."""
    for times in (20, 50, 100):
        for k in range(25):
            passage = " ".join(f"p{k}x{i}" for i in range(50))
            rest = " ".join(f"r{k}x{i}" for i in range(100))
            own = " ".join(f"o{k}x{i}" for i in range(20))
            texts = [" ".join([passage] * 2 + [rest]), " ".join([passage] * times + [rest]),
                     " ".join([passage] * 2 + [rest] + [own] * times)]
            (_, _, t), = chunks(pa.array(texts), lower=True)
            owner, value = nd.distinct(*nd.shingles(t))
            keys = nd.band_keys(nd.prob_min_hash(owner, value, np.ones(len(owner)), 3, nd.BANDS * nd.ROWS), nd.BANDS, nd.ROWS)
            assert set(keys[0]) == set(keys[1]) and set(keys[0]) & set(keys[2])


def test_copies_with_repeats_are_one_class(docs):
    rows = []
    for k in range(30):
        passage, rest = (" ".join(f"{c}{k}x{i}" for i in range(n)) for c, n in (("p", 50), ("r", 100)))
        rows += [(2 * k, " ".join([passage] * 2 + [rest])), (2 * k + 1, " ".join([passage] * 60 + [rest]))]
    assert all(r.class_id == r.doc_id // 2 * 2 for r in nd.near_duplicates(docs(rows)).collect())
