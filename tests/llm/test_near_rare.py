"""Large groups of copies that are not alike enough: parted by rare shingles, without loss."""

import random

import numpy as np
from pyspark.sql import functions as F

from acctlens.llm import near_dedup as nd
from test_near_dedup import brute_classes, edited


def loose_group(rnd, n, edits):
    """Copies of one text with so many edits that few are 0.8 alike, every ninth one with a near copy."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    while len(texts) < n:
        texts.append(edited(rnd, base, edits))
        if len(texts) % 9 == 0:
            texts.append(edited(rnd, texts[-1].split(), 2))
    return list(enumerate(texts[:n]))


def test_loose_group_against_all_pairs(docs):
    rnd = random.Random(3)
    pairs = loose_group(rnd, 260, 7) + [(1000 + i, edited(rnd, [f"w{i}" for i in range(200)], 1)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(pairs)).collect()}
    wanted = brute_classes(pairs)
    assert [got[i] for i, _ in pairs] == wanted and len(set(wanted)) > 100


def test_comparisons_of_a_loose_group_do_not_grow_with_its_square(docs, monkeypatch):
    compared, verifier = [], nd._verifier

    def counting(*given):
        verify = verifier(*given)
        return lambda pairs: (compared.append(pairs.count()), verify(pairs))[1]

    monkeypatch.setattr(nd, "_verifier", counting)
    n = 500
    nd.near_duplicates(docs(loose_group(random.Random(4), n, 7))).count()
    # All pairs would be 250 for each.
    assert sum(compared) < 30 * n


def test_rarest_shingles_miss_no_pair():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        x = rnd.choice(10**6, rnd.integers(1, 80), replace=False).astype(np.uint64) << np.uint64(20)
        y = np.unique(np.concatenate([rnd.permutation(x)[: rnd.integers(0, len(x) + 1)], rnd.integers(0, 10**6, rnd.integers(1, 9)).astype(np.uint64) << np.uint64(20)]))
        counts = rnd.integers(0, 4, nd.CELLS)
        if nd.jaccard(np.unique(x).tobytes(), y.tobytes()) < 0.8:
            continue
        m, n = len(x), len(y)
        shared = int(np.ceil(0.8 / 1.8 * (m + n) - 1e-6))
        a, b = nd.rarest(x, counts, 0.8), nd.rarest(y, counts, 0.8)
        assert len(a) >= m - shared + 1 and len(b) >= n - shared + 1
        assert set(a[: m - shared + 1].tolist()) & set(b[: n - shared + 1].tolist())


def test_places_of_a_pair(spark):
    row = spark.range(1).select(F.struct(F.lit(16).alias("pos"), F.lit(146).alias("size")).alias("x"), F.struct(F.lit(17).alias("pos"), F.lit(146).alias("size")).alias("y"))
    assert not row.select(nd._places_within(0.8)).first()[0]
    assert row.select("x", F.col("x").alias("y")).select(nd._places_within(0.8)).first()[0]
