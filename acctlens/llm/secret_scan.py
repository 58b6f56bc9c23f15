"""Secret scan over an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content. The ledger holds what a
version of the rules found in a blob, blobs without a finding included; only pairs of blob and rule
version that it lacks are scanned, each once, however many paths share the blob. Findings are then
joined back to all paths.

Null text: scanned as the empty text. Repeated rows get equal findings, one row each. Positions are
code points of the whole text. Only ``doc_id`` (the path) and ``text`` are read. An empty table gives
no rows and leaves the ledger as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from acctlens.llm.rows import packed_rows, unpacked_rows
from acctlens.llm.textbytes import batches
from acctlens.operators.joins import lookup_join
from acctlens.sources.tables import settle

RULES_VERSION = 1


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: re.Pattern
    keeps: Callable[[re.Match], bool] = lambda m: True
    # Lower-case texts of which one must be there for a match.
    hints: tuple[str, ...] = ()


# Fixed values of the contract: the patterns and least lengths of the three base kinds.
BASE_RULES = [
    SecretRule(
        "assign",
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: len(m[2]) >= 6, ("passw", "secret", "token", "api"),
    ),
    SecretRule("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20, ("akia",)),
    # Runs under 24 characters would be dropped.
    SecretRule("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")),
]
MORE_RULES = [
    SecretRule("pem", re.compile(
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
        # Up to the end, whatever lies between, or else header lines and base64 only.
        r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n)*+[A-Za-z0-9+/=\s]+)"), hints=("-----begin",)),
    SecretRule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), hints=("eyj",)),
    SecretRule("login", re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]++:[^\s:/@]{3,}+@"), hints=("://",)),
]
RULES = BASE_RULES + MORE_RULES
LEDGER = (
    "blob string, rules_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then in the order of the rules."""
    lower, found = text.lower(), []
    for order, rule in enumerate(RULES):
        if rule.hints and not any(h in lower for h in rule.hints):
            continue
        found += [(m.start(), order, rule.kind, m.end()) for m in rule.pattern.finditer(text) if rule.keeps(m)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_blobs(blobs: DataFrame, version: int = RULES_VERSION) -> DataFrame:
    """Ledger rows of blobs (blob, text)."""
    base = [r.kind for r in BASE_RULES]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    spans = find_secrets(text or "")
                    basic = [s for s in spans if s[0] in base]
                    digest = hashlib.sha256(_joined(basic).encode()).hexdigest()
                    rows.append((version, *[sum(s[0] == k for s in basic) for k in base], digest, _joined(spans)))
                kinds = (pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                names = ["rules_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([part.column("blob"), *columns], ["blob", *names])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def with_blob(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))


def grow_ledger(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> DataFrame:
    """New ledger rows: the blobs of ``docs`` that this version of the rules has not seen."""
    blobs = with_blob(docs)
    if ledger is not None:
        seen = ledger.where(F.col("rules_version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    # Copies are reduced to one in each task before anything moves.
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return settle(scan_blobs(once, version), "ledger")


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger with the new rows)."""
    new = grow_ledger(docs, ledger, version)
    full = new if ledger is None else ledger.unionByName(new)
    known = full.where(F.col("rules_version") == version).drop("rules_version")
    paths = settle(with_blob(docs).select("doc_id", "blob"), "paths")
    return lookup_join(paths, known, "blob").drop("blob"), full


def redacted(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones merged, replaced by the mark."""
    cuts = sorted((int(a), int(b)) for _, a, b in (s.rsplit(":", 2) for s in spans.split(",") if s))
    out, at = [], 0
    for start, end in cuts:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with what the ledger knows of their blobs cut out of ``text``.

    An ``n_chars`` column follows the text. Texts without a finding stay as they are, null stays null.
    """
    new = grow_ledger(docs, ledger)
    full = new if ledger is None else ledger.unionByName(new)
    known = full.where((F.col("rules_version") == RULES_VERSION) & (F.col("spans") != ""))
    tagged = packed_rows(docs, F.sha2("text", 256).alias("blob"), F.col("text"))
    counts = tagged.groupBy("blob").agg(F.count(F.lit(1)).alias("_n"))
    found = lookup_join(tagged, known.select("blob", "spans"), "blob", counts=counts)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in batches(whole, "text"):
                spans, texts = part.column("spans").to_pylist(), part.column("text").to_pylist()
                cut = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), cut, pa.array([bool(s) for s in spans])], ["row", "text", "cut"])

    cut = found.select("row", "text", "spans").mapInArrow(run, T.StructType([found.schema["row"], T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())]))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("cut"), chars).otherwise(F.col("row").getField("n_chars"))
    return unpacked_rows(cut, docs, **changed)
