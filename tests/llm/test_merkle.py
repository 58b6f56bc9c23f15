"""Merkle manifest: against a recursion with hashlib over all rows, and against the SQL."""

import hashlib
import zlib

import pytest
from acctlens.llm import merkle
from acctlens.llm.oracle import oracle_sql
from acctlens.llm.queries import registry
from compare import connect, differences


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(tree, at, digest):
    """(digest at the top, siblings) from place ``at`` of a tree's first level."""
    proof = []
    while len(tree) > 1:
        low = at // 8 * 8
        run = tree[low : low + 8]
        proof += run[: at - low] + run[at - low + 1 :]
        digest = h(*run[: at - low], digest, *run[at - low + 1 :])
        tree = [h(*tree[i : i + 8]) for i in range(0, len(tree), 8)]
        at //= 8
    return digest, proof


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((leaf(row, row["text"]), row))
    for own in trees.values():
        own.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"], x[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = [climb([d for d, _ in trees[g]], 0, trees[g][0][0])[0] for g in langs]
    root = climb(tops, 0, tops[0])[0] if tops else None
    out = []
    for k, g in enumerate(langs):
        digests = [d for d, _ in trees[g]]
        for at, (digest, row) in enumerate(trees[g]):
            start, text = digest, row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and text is not None:
                start = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            top, proof = climb(digests, at, start)
            folded, more = climb(tops, k, top)
            out.append((row["doc_id"], digest, tops[k], root, h(*proof, *more), folded, folded == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def check(docs):
    assert got(merkle.proofs(docs)) == brute([r.asDict() for r in docs.collect()])


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place bigint, entries string, tree string"


@pytest.fixture
def table(frame):
    return lambda rows: frame([(i, t, g, "s" if i is None or i % 2 else None, n, 7, "x", "t") for i, t, g, n in rows], SCHEMA)


def test_documents_match_sql_and_brute_force(spark, sf_dir, documents):
    check(documents)
    df = registry()["op12_merkle_manifest"](spark, sf_dir)
    assert differences(df, connect(sf_dir), oracle_sql()["op12_merkle_manifest"]) == []


def test_odd_rows(table):
    check(table([
        (1, "ABC", "en", 3), (2, None, "en", None), (2, None, "en", None), (None, "Ab", "en", 2), (None, None, None, None), (3, "É Σ A", None, 5),
        (4, "", "", 0), (5, "x" * 70_000 + "Z", "é", 1), (6, "Q", "z", 1), *[(7, "copy C", "en", 6)] * 70, (-3, "NEG", "en", 3)]))


def test_one_row_one_language_many_languages(table):
    check(table([(9, "Text", "en", 4)]))
    check(table([(i, f"Text {i}", "en", i) for i in range(75)]))
    check(table([(i, f"Text {i}", f"lang{i % 70}", i) for i in range(90)]))
    assert got(merkle.proofs(table([]))) == []


def test_hot_nodes_are_spread(table, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 3)
    check(table([(i, f"Text {i}", "en" if i % 4 else f"l{i % 20}", i) for i in range(600)]))


def test_only_tampered_rows_fail(table):
    rows = merkle.proofs(table([(i, "UPPER" if i % 2 else "lower", "en", 5) for i in range(200)])).collect()
    wrong = {r["doc_id"] for r in rows if not r["verified"]}
    assert wrong == {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 3 == 0}
    assert len({r["root"] for r in rows}) == 1
