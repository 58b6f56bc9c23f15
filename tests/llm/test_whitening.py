"""Whitening: against a dense eigensolver and exact whole-number arithmetic on all rows."""

import math

import numpy as np
import pytest
from acctlens.llm import feast, whitening
from acctlens.llm.queries import registry

SCHEMA = "vec_id bigint, embedding array<double>, label int, part int, slice int, n bigint"


@pytest.fixture
def table(frame):
    return lambda rows: frame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, wanted=32):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows (id, vector)."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[float(a) - s / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return {(rows[i][0], j + 1): (n, dev[i], abs(white[i, j]), values[j] / values.sum()) for i in range(n) for j in range(k)}


def check(df, rows, wanted=32):
    got, want = df.collect(), brute(rows, wanted)
    assert len(got) == len(want)
    for r in got:
        n, dev, white, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(abs(r["whitened"]) - white) < 1e-7 and abs(r["explained"] / share - 1) < 1e-9
        assert 0 <= r["identity_error"] < 1e-8
    if got:
        by = np.zeros((len(rows), max(r["component"] for r in got)))
        place = {i: k for k, (i, _) in enumerate(rows)}
        for r in got:
            by[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        by -= by.mean(axis=0)
        assert abs(by.T @ by / len(by) - np.eye(by.shape[1])).max() < 1e-8


def test_all_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(registry()["op13_embedding_whitening"](spark, sf_dir), rows)


def test_odd_rows(table):
    random = np.random.default_rng(3)
    good = [(i, (random.standard_normal(5) * [9, 3, 3, 1, 0.2]).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    check(whitening.whiten(table(good + odd)), good)
    check(whitening.whiten(table(good), 3), good, 3)


def test_rows_without_components(table):
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(table([(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table([(1, [1.0, 2.0])] * 9)).collect() == []


def test_low_rank_and_repeated_rows(table):
    random = np.random.default_rng(5)
    base = random.integers(-50, 50, (7, 12)).astype(float)
    rows = [(i, base[i % 7].tolist()) for i in range(21)]
    df = whitening.whiten(table(rows))
    assert df.agg({"component": "max"}).first()[0] == 6
    check(df, rows)
    same = df.select("vec_id", "component", "whitened").collect()
    by = {(r[0], r[1]): r[2] for r in same}
    assert all(abs(by[i, c] - by[i % 7, c]) < 1e-9 for i, c in by)


def test_deviation_that_exceeds_a_long():
    x = np.array([[1 << 44, 0], [0, 0], [1 << 30, 5]])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert whitening.deviations(x, n, x.sum(axis=0)) == [e if e < 1 << 63 else None for e in exact] == [None] * 3
    small = np.array([[1_000_003, 999_000], [1_000_000, 1_000_000]])
    assert whitening.deviations(small, 2, small.sum(axis=0)) == [9 + 1000**2] * 2


@pytest.mark.parametrize("spectrum", [
    np.ones(20), np.arange(1.0, 41.0), 2.0 ** -np.arange(40), np.repeat([5.0, 3.0, 1.0], 12), 1 + 1e-9 * np.arange(40),
    np.concatenate([[1e6], np.linspace(1, 1.1, 50)]), np.zeros(6), np.concatenate([np.arange(1.0, 5.0), np.zeros(30)])])
def test_feast_finds_all(spectrum):
    random = np.random.default_rng(len(spectrum))
    q, _ = np.linalg.qr(random.standard_normal((len(spectrum),) * 2))
    a = q * spectrum @ q.T
    a = (a + a.T) / 2
    inertia = feast.Inertia(a)
    want = np.sort(spectrum)[::-1]
    points = np.array([0.5, 2.5, 4.9, 1.05, 100.0])
    clear = [p for p in points if abs(want - p).min() > 1e-6]
    assert inertia.below(np.array(clear)).tolist() == [(want < p).sum() for p in clear]
    got = [feast.eigenpairs(a, *i) for i in inertia.intervals(32)]
    values = np.concatenate([v for v, _ in got]) if got else np.zeros(0)
    n = min(32, int((want > inertia.least).sum()))
    assert len(values) >= n and np.allclose(values[:n], want[:n], rtol=0, atol=1e-13 * max(1, want[0]) * len(want))
    for v, x in got:
        assert np.sqrt(((a @ x - x * v) ** 2).sum(axis=0)).max() < 1e-12 * want[0] * len(want)
