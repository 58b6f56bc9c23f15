import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from acctlens.llm import quality_rules as q
from acctlens.llm.oracle import oracle_sql
from acctlens.llm.queries import op6_quality_rules
from acctlens.llm.textbytes import chunks
from compare import connect, differences

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    lettered = sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", w)) for w in words)
    bad = (10 * counts[2] > len(words) or 10 * counts[3] > 6 * len(lines) or counts[1] < 2 * len(words)
           or counts[1] > 25 * len(words) or 10 * lettered < 6 * len(words) or 10 * upper > 6 * letters)
    return counts, failed, not failed and not bad


def check(rows, pairs):
    wanted = Counter((i, *brute(t)[0], brute(t)[1], brute(t)[2]) for i, t in pairs)
    assert Counter(tuple(r) for r in rows) == wanted


def test_documents(spark, documents, sf_dir):
    check(op6_quality_rules(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_against_sql(spark, sf_dir):
    assert differences(op6_quality_rules(spark, sf_dir), connect(sf_dir), oracle_sql()["op6_quality_rules"]) == []


def test_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    check(q.quality_report(frame).collect(), odd_rows)
    kept = q.keep_good(frame)
    assert kept.schema == frame.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in odd_rows if brute(t)[2])
    assert q.quality_report(docs([])).count() == q.keep_good(docs([])).count() == 0


@pytest.mark.parametrize("limit", [1, 40, 10**6])
def test_any_order_and_chunk_gives_the_same(limit):
    rnd = random.Random(limit)
    words = ["a", "THE", "é!", "#x", "12", "word", "long" * 9]
    texts = ["".join(rnd.choice(words) + rnd.choice(" \n  \t") for _ in range(rnd.randrange(70))) for _ in range(150)]
    texts += ["", " ", "x", None]
    for _ in range(3):
        rules = rnd.sample(q.RULES, len(q.RULES))
        got = [q.passes(t, rules, np.ones(t.n, bool)) for _, _, t in chunks(pa.array(texts), limit=limit)]
        assert np.concatenate(got).tolist() == [brute(t)[2] for t in texts]


def test_cascade_runs_cheap_rejections_first_and_only_on_the_rest(docs):
    seen = []

    def rule(name, share, cost):
        def rejects(t):
            seen.append((name, t.n))
            sum(range(cost))
            return np.arange(t.n) < share * t.n
        return q.Rule(name, rejects)

    frame = docs([(i, f"text {i}") for i in range(100)])
    slow, quick, idle = rule("slow", 0.5, 400_000), rule("quick", 0.5, 10), rule("idle", 0, 10)
    assert [r.name for r in q.plan_cascade(frame, [slow, idle, quick])] == ["quick", "slow", "idle"]
    seen.clear()
    texts = next(chunks(pa.array([f"t {i}" for i in range(100)])))[2]
    q.passes(texts, [quick, slow], np.ones(100, bool))
    assert seen == [("quick", 100), ("slow", 50)]


def test_labels(spark, sf_dir, documents):
    """Junk goes, and clean documents of a fair length stay."""
    report = {r.doc_id: r for r in op6_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [report[r.doc_id].kept for r in labels if r.quality == 1 and not report[r.doc_id].base_failed]
    junk = [report[r.doc_id].kept for r in labels if r.quality == 0]
    assert all(good) and sum(junk) <= 0.05 * len(junk)
