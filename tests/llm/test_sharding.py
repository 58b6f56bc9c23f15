import random
import zlib
from collections import Counter, defaultdict

import pytest

from acctlens.llm import sharding


def brute(sizes, shards):
    """The smallest largest sum of at most ``shards`` runs."""
    low = max(sizes)
    while True:
        used, room = 1, low
        for s in sizes:
            if s > room:
                used, room = used + 1, low
            room -= s
        if used <= shards:
            return low
        low += 1


def check(rows, pairs, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs), key=repr)
    by_shard = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    of_text = defaultdict(set)
    for r in rows:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in of_text.values())


@pytest.mark.parametrize("seed, shards", [(1, 8), (2, 3), (3, 1)])
def test_smallest_capacity(docs, seed, shards):
    rnd = random.Random(seed)
    pairs = [(i, "x" * rnd.randrange(60) + str(rnd.randrange(40))) for i in range(120)]
    rows = sharding.minimax_shards(docs(pairs), shards).collect()
    check(rows, pairs, shards)
    groups = [r["size"] for r in sharding.running_sizes(docs(pairs)).orderBy("digest").collect()]
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) == brute(groups, shards)


def test_odd_rows(docs, odd_rows):
    check(sharding.minimax_shards(docs(odd_rows)).collect(), odd_rows, 8)
    check(sharding.minimax_shards(docs([(1, None), (1, None)])).collect(), [(1, None), (1, None)], 8)
    assert sharding.minimax_shards(docs([])).count() == 0


def test_hot_group_is_split_over_cells(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS text")
    rows = sharding.minimax_shards(df).collect()
    check(rows, [(i, "hot" if i % 3 == 0 else str(i)) for i in range(30_000)], 8)


def test_plan_has_no_python(documents):
    plan = sharding.minimax_shards(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
