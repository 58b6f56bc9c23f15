import hashlib
import random
import re
from collections import Counter

import pytest

from acctlens.llm import secret_scan as ss
from acctlens.llm.queries import op10_secret_scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def check(rows, pairs):
    def row(i, t):
        spans = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        return i, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()

    assert Counter(tuple(r)[:5] for r in rows) == Counter(row(i, t) for i, t in pairs)
    for r in rows:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert sum(k in ("assign", "access", "hex") for k in kinds) == r.n_assign + r.n_access + r.n_hex


def test_documents(spark, documents, sf_dir):
    check(op10_secret_scan(spark, sf_dir).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_base_spans_of_random_texts():
    rnd = random.Random(6)
    parts = ["password", "PassWd", "ſecret", "toKen", "api_key", "apikey", "=", " : ", "'", '"', "AKIA", "AKIAAKIA", "ABCDEFGH12345678",
             "deadbeef" * 3, "0a" * 11, "é", "\n", "x", "hunter22", " ", "F", "Kelvin"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        base = [s for s in ss.find_secrets(text) if s[0] in ("assign", "access", "hex")]
        assert base == brute(text), text


def test_more_kinds():
    text = "see postgres://me:pa55word@host and -----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.abc_DEF"
    assert [k for k, _, _ in ss.find_secrets(text)] == ["login", "pem", "jwt"]


def test_odd_rows(docs, odd_rows):
    frame = docs(odd_rows)
    findings, ledger = ss.scan_history(frame)
    check(findings.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect(), odd_rows)
    assert ledger.count() == len({t or "" for _, t in odd_rows})
    out = ss.redact_secrets(frame)
    assert out.schema.names == frame.schema.names and out.count() == len(odd_rows)
    texts = {r.doc_id: r for r in out.collect()}
    assert "hunter22" not in texts[10].text and "[secret]" in texts[10].text and texts[10].n_chars == len(texts[10].text)
    assert texts[3].text is None and texts[8].text == "x" * 70_000
    assert ss.scan_history(docs([]))[0].count() == ss.redact_secrets(docs([])).count() == 0


def test_only_unseen_pairs_are_scanned(docs, monkeypatch):
    scanned = []
    whole = ss.scan_blobs

    def counted(blobs, version=ss.RULES_VERSION):
        scanned.append(sorted(r.text for r in blobs.collect()))
        return whole(blobs, version)

    monkeypatch.setattr(ss, "scan_blobs", counted)
    _, ledger = ss.scan_history(docs([(1, "a"), (2, "a"), (3, "password=abcdef1")]))
    found, ledger = ss.scan_history(docs([(4, "a"), (5, "b"), (6, "password=abcdef1")]), ledger)
    assert {r.doc_id: r.n_assign for r in found.collect()} == {4: 0, 5: 0, 6: 1}
    _, ledger = ss.scan_history(docs([(7, "b")]), ledger, version=2)
    assert scanned == [["a", "password=abcdef1"], ["b"], ["b"]]
    assert Counter((r.rules_version) for r in ledger.collect()) == {1: 3, 2: 1}


@pytest.mark.parametrize("text, spans, wanted", [
    ("abcdef", "", "abcdef"), ("abcdef", "x:1:3", "a[secret]def"), ("abcdef", "x:1:3,y:2:5", "a[secret]f"),
    ("abcdef", "x:0:2,y:4:6", "[secret]cd[secret]"), ("abcdef", "x:1:5,y:2:3", "a[secret]f"),
])
def test_redacted(text, spans, wanted):
    assert ss.redacted(text, spans) == wanted
