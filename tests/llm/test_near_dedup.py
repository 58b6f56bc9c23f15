import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from compare import connect, differences

from acctlens.llm import near_dedup as nd
from acctlens.llm.oracle import oracle_sql
from acctlens.llm.queries import op4_near_dedup
from acctlens.llm.linking import SMALL_BUCKET, connected, linked, shared_buckets


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_classes(pairs):
    """Row number -> smallest doc_id of its class, all pairs compared."""
    sets = [None if t is None else shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if pairs[i][1] is None or pairs[j][1] is None:
                continue
            both = len(sets[i] & sets[j])
            alike = pairs[i][1] == pairs[j][1] or (both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8)
            if alike:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(pairs)):
        members[find(i)].append(pairs[i][0])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(pairs))]


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(docs):
    rnd = random.Random(5)
    pairs = []
    for g in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 200))]
        for k in range(rnd.randrange(1, 6)):
            pairs.append((len(pairs), edited(rnd, base, rnd.randrange(0, 4))))
    pairs += [(900, pairs[0][1]), (901, pairs[0][1].upper())]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs(pairs)).collect()}
    assert [got[i] for i, _ in pairs] == brute_classes(pairs)


def test_documents(documents):
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(documents).collect()}
    assert [got[i] for i, _ in pairs] == brute_classes(pairs)
    kept = nd.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_against_sql(spark, sf_dir):
    assert differences(op4_near_dedup(spark, sf_dir), connect(sf_dir), oracle_sql()["op4_near_dedup"]) == []


def test_large_group_of_near_copies(docs):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    pairs = [(i, edited(rnd, base, 2)) for i in range(400)] + [(1000 + i, edited(rnd, [f"v{i}x{k}" for k in range(60)], 0)) for i in range(30)]
    rows = {r.doc_id: r for r in nd.near_duplicates(docs(pairs)).collect()}
    assert {rows[i].class_id for i in range(400)} == {0} and rows[7].n_texts == 400
    assert all(rows[1000 + i].class_id == 1000 + i for i in range(30))


def test_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    got = Counter((r.doc_id, r.class_id) for r in nd.near_duplicates(frame).collect())
    wanted = Counter((i, i if t is None else c) for (i, t), c in zip(odd_rows, brute_classes(odd_rows)))
    assert got == wanted
    kept = nd.drop_near_duplicates(frame)
    assert kept.schema == frame.schema
    # both null texts stay, and one row for each other class
    classes = {c for (i, t), c in zip(odd_rows, brute_classes(odd_rows)) if t is not None}
    assert kept.count() == 2 + len(classes)
    assert nd.near_duplicates(docs([])).count() == nd.drop_near_duplicates(docs([])).count() == 0


def test_signature_estimates_probability_jaccard():
    rnd = np.random.default_rng(2)
    names = rnd.integers(1, 2**63, 400).astype(np.uint64)
    x, y = rnd.integers(0, 5, 400).astype(float), rnd.integers(0, 5, 400).astype(float)
    places = 1024

    def signature(w):
        at = np.flatnonzero(w)
        return nd.prob_min_hash(np.zeros(len(at), int), names[at], w[at], 1, places)[0]

    true = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(400) if x[d] and y[d])
    assert abs((signature(x) == signature(y)).mean() - true) < 0.06
    assert (nd.prob_min_hash(np.zeros(1, int), names[:1], np.ones(1), 1, 128) == names[0]).all()


def test_linked_compares_what_is_not_connected(spark):
    # one bucket of two groups that are not alike, so that every pair across them must be refused
    n = 6 * SMALL_BUCKET
    members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), "id")
    members = shared_buckets(members, members.select("id", F.lit(1).alias("size")))
    roots = linked(members, lambda pairs: pairs.where("a % 2 = b % 2"))
    assert {r.id: r.root for r in roots.collect()} == {i: i % 2 for i in range(2, n)}
    # a chain: only neighbours are alike
    roots = linked(members, lambda pairs: pairs.where("b - a = 1"))
    assert {r.id: r.root for r in roots.collect()} == {i: 0 for i in range(1, n)}


def test_connected(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(500) if find(i) != i}
