import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctlens.llm import vector_search as vs
from acctlens.llm.queries import op8_vector_search


def brute(rows, k=5):
    """(query, rank, id) and score, all candidates by hand; rows: (id, vector)."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    out = {}
    for q in range(len(rows)):
        if ids[q] % 50:
            continue
        score = unit @ unit[q]
        score[q] = -9
        order = np.lexsort((ids, -np.round(score, 12)))[: min(k, len(rows) - 1)]
        for rank, j in enumerate(order, 1):
            out[int(ids[q]), rank] = (int(ids[j]), float(score[j]))
    return out


def check(rows, wanted):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert got.keys() == wanted.keys() and len(got) == len(rows)
    for key, (vec_id, score) in got.items():
        assert vec_id == wanted[key][0] and score == pytest.approx(wanted[key][1], abs=1e-12)


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op8_vector_search(spark, sf_dir).collect(), brute(rows))


def test_many_shards_and_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vs, "SHARD_ROWS", 60)
    monkeypatch.setattr(vs, "BLOCK_ROWS", 3)
    rnd = random.Random(3)
    hot = [rnd.gauss(0, 1) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    check(vs.nearest(table, F.col("vec_id") % 50 == 0).collect(), brute(rows))


@pytest.mark.parametrize("relax, least", [(1.0, 1.0), (3.0, 0.9)])
def test_recall_by_factor(relax, least):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 8))
    unit = vs._unit(centres[rng.integers(0, 30, 4000)] + 0.2 * rng.standard_normal((4000, 8)))
    queries = unit[::40]
    tree = vs.build_tree(unit)
    point, work = vs.search_tree(tree, unit, queries, 6, relax)
    true = np.argsort(-(queries @ unit.T), axis=1, kind="stable")[:, :6]
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(point, true)])
    assert recall >= least
    # Near points are found without looking at all the others.
    assert work < 0.7 * len(queries) * len(unit)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5]), (150, [0.0, 0.0]),
            (9, [1e300, 1e300]), (10, [1e-300, 0.0])]
    schema = "vec_id bigint, embedding array<double>, query_id int, `rank` int, shard int, score double, k int, dim int"
    table = spark.createDataFrame([(*r, 1, 1, 1, 1.0, 1, 1) for r in rows], schema)
    got = vs.nearest(table, F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 100, 150)}
    assert by[50] == by[150] == []          # no other vector of its dimension; takes no part
    assert by[0][:2] == [1, 10] or by[0][:2] == [1, 100]
    assert len(by[0]) == 5 and set(by[0]) == {1, 2, 9, 10, 100} and by[100][0] == 9 and len(by[100]) == 5
    assert vs.nearest(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
