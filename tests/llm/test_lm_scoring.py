import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from acctlens.llm import gru, lm_scoring as lm
from acctlens.llm.queries import op5_lm_scoring


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check(rows, pairs):
    counts = Counter(w for i, t in pairs if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(((i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
                      sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in pairs), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=repr)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_documents(spark, documents, sf_dir):
    rows = op5_lm_scoring(spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()])
    unseen = [r for r in rows if r.held_out]
    # Held-out texts are likelier to the network than to the counts.
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_odd_rows(docs, odd_rows):
    rows = lm.score_documents(docs(odd_rows)).collect()
    check(rows, odd_rows)
    twins = [r.score for r in rows if r.doc_id == 2]
    assert twins[0] == pytest.approx(twins[1])
    assert lm.score_documents(docs([])).count() == 0
    only_held = [(i, "a b") for i in range(200) if held(i)][:2]
    check(lm.score_documents(docs(only_held)).collect(), only_held)


@pytest.fixture
def net():
    rng = np.random.default_rng(0)
    flat = gru.initial(rng.integers(1, 100, gru.IDS).astype(float)).astype(np.float64)
    return flat + rng.standard_normal(gru.SIZE) * 0.05, rng


def test_gradient(net):
    flat, rng = net
    ids, target = rng.integers(0, gru.IDS, (6, 4)), rng.integers(0, gru.IDS, (6, 4))
    mask, state = rng.random((6, 4)) > 0.2, rng.standard_normal((4, gru.HIDDEN)) * 0.1
    live = np.flatnonzero(mask.ravel())

    def loss(x):
        states, _ = gru.steps(gru.views(x), ids, state)
        return -gru.log_chances(gru.views(x), states.reshape(-1, gru.HIDDEN)[live].astype(float), target.ravel()[live]).mean()

    grad, _ = gru.gradient(flat, ids, target, mask, state)
    at = 0
    for shape in gru.SHAPES.values():
        n = int(np.prod(shape))
        for i in at + np.argsort(-np.abs(grad[at : at + n]))[:3]:
            step = np.zeros_like(flat)
            step[i] = 1e-3
            assert grad[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-3, rel=2e-2, abs=1e-5)
        at += n


def test_chances_sum_to_one(net):
    flat, rng = net
    state = rng.standard_normal((1, gru.HIDDEN))
    every = np.exp(gru.log_chances(gru.views(flat), np.repeat(state, gru.IDS, axis=0), np.arange(gru.IDS)))
    assert every.sum() == pytest.approx(1.0)


def test_state_is_carried_through_whole_texts(net):
    flat, rng = net
    flat = flat.astype(np.float32)
    sizes = np.array([1, 5, gru.WINDOW, gru.WINDOW + 1, 500, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(0, gru.IDS, starts[-1])
    got = gru.score(flat, tokens, starts, first=7, side=4)
    for i in range(len(sizes)):
        text = tokens[starts[i] : starts[i + 1]]
        states, _ = gru.steps(gru.views(flat), np.concatenate([[7], text[:-1]])[:, None], np.zeros((1, gru.HIDDEN), np.float32))
        assert got[i] == pytest.approx(gru.log_chances(gru.views(flat), states[:, 0], text).sum(), rel=1e-4)


def test_training_learns_an_order():
    """Ids that follow each other in a cycle become nearly certain."""
    ids = (np.arange(64)[:, None] + np.arange(32)) % 10 * 48
    flat = gru.initial(np.bincount(np.arange(10) * 48, minlength=gru.IDS) * 1000.0)
    trainer = gru.Trainer(flat, rate=0.1)
    for _ in range(30):
        trainer.windows(ids[:-1], ids[1:], np.ones((63, 32), bool))
    states, _ = gru.steps(gru.views(trainer.flat), ids[:-1], np.zeros((32, gru.HIDDEN), np.float32))
    chances = gru.log_chances(gru.views(trainer.flat), states[20:].reshape(-1, gru.HIDDEN), ids[21:].ravel())
    assert chances.mean() > np.log(0.5)
