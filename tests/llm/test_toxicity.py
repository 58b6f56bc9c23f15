"""Toxicity: sets and scores against plain Python, the regression against its optimum, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from acctlens.llm import toxicity
from acctlens.llm.queries import registry


def plain_bins(text):
    """The bins of a text, one n-gram after the other."""
    text = " " + " ".join((text or "").lower().split()) + " "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(text) - n + 1):
            h = 0
            for k in range(n):
                h = (h * int(toxicity.FACTOR) + ord(text[i + k]) + 1) % (1 << 64)
            out.add((h * 0xD6E8FEB86659FD93) % (1 << 64) >> 64 - toxicity.BIN_BITS)
    return out


def sets(texts, lookup=None):
    held = toxicity._sets(texts, lookup)
    return [set((held[held >> toxicity.BIN_BITS == i] & ((1 << toxicity.BIN_BITS) - 1)).tolist()) for i in range(len(texts))]


TEXTS = ["Some Text  with\nspace", None, "", "É ß Σ x", "😀"[:0] + "😀😀 ok", "a", "some text with space", "tail of it " * 40]


def test_sets_match_plain_python(monkeypatch):
    assert sets(TEXTS) == [plain_bins(t) for t in TEXTS]
    for piece in (7, 50):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert sets(TEXTS) == [plain_bins(t) for t in TEXTS]


def test_scores_match_plain_python():
    known = sorted(plain_bins("some tail"))
    model = toxicity.Classifier(np.array(known), np.linspace(-1, 1, len(known)), 0.25)
    weight = dict(zip(known, model.weights))
    want = [1 / (1 + math.exp(-0.25 - sum(weight.get(b, 0) for b in plain_bins(t)))) for t in TEXTS]
    assert np.allclose(model.scores(TEXTS, model.lookup()), want, atol=1e-12)
    many = TEXTS * 100
    assert np.allclose(model.scores(many, model.lookup()), want * 100, atol=1e-12)


def test_regression_is_at_its_optimum():
    r = np.random.default_rng(2)
    x = r.random((80, 12)) < 0.3
    y = (x @ r.standard_normal(12) + r.standard_normal(80)) > 0.2
    scale = r.standard_normal(12)
    rows, columns = np.nonzero(x)
    w, b = toxicity.logistic(rows, columns, scale, y)
    weight = np.where(y, 40 / y.sum(), 40 / (~y).sum())
    z = x @ (w * scale) + b
    pull = (1 / (1 + np.exp(-z)) - y) * weight
    assert abs(np.append((x.T @ pull) * scale + toxicity.PENALTY * w, pull.sum())).max() < 0.05


def test_held_out_accuracy(spark):
    """A third of the toxic texts are very long; languages and sources are the same for both."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghilmnoprst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    bad = ["vilegrub", "snotlump", "dimwhack"]
    rows, labels = [], []
    for i in range(500):
        text = [r.choice(words) for _ in range(r.choice([5, 60, 900]))]
        toxic = i % 4 == 0
        for _ in range(max(1, len(text) // 80) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if toxic else 0))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if got[i]["held_out"]) == sorted(held) and len(held) > 60
    right = sum(got[i]["predicted"] == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(x["predicted"] == (x["score"] >= 0.5) for x in got.values())


def test_only_training_labels_are_learnt(docs, spark):
    rows = [(i, "vilegrub here" if i % 2 else "calm words") for i in range(120)]
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    real = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")
    lying = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(120)], "doc_id bigint, toxic int")
    a, b = (sorted(map(tuple, toxicity.score_documents(docs(rows), t).collect())) for t in (real, lying))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])
    assert all(x[3] == x[0] % 2 for x in a)


def test_odd_rows(docs, odd_rows, spark):
    schema = "doc_id bigint, toxic int, quality int, text string"
    none = toxicity.score_documents(docs(odd_rows), spark.createDataFrame([], schema)).collect()
    assert len(none) == len(odd_rows) and {r["predicted"] for r in none} == {0} and all(0 <= r["score"] < 0.01 for r in none)
    given = [(i, i % 2, 0, "x") for i, _ in odd_rows if i is not None] + [(None, 1, 0, "x"), (1, None, 0, "x"), (999, 1, 0, "x"), (1, 1, 1, "x"), (1, 0, 1, "x")]
    out = toxicity.score_documents(docs(odd_rows), spark.createDataFrame(given, schema)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert {r["held_out"] for r in out if r["doc_id"] is None} == {True}
    empty = toxicity.score_documents(docs([]), spark.createDataFrame(given, schema))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "score", "predicted"]
    one = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x")], schema)
    assert {r["predicted"] for r in toxicity.score_documents(docs(odd_rows), one).collect()} <= {0, 1}


def test_registered_query(spark, sf_dir, documents):
    out = registry()["op11_toxicity"](spark, sf_dir)
    assert out.count() == documents.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.85
