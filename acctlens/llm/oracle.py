"""DuckDB SQL for the queries on training data that SQL can express.

The others have none: tokens, checksums by CRC, simhashes, packings, trees, models and positions of
matches are compared with brute force in the tests.
"""

from __future__ import annotations

import string

_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
    FROM d),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, text) AS copies
    FROM (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS text
          FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))),
covered AS (
    SELECT r, count(DISTINCT p) AS n
    FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE copies > 1) GROUP BY r),
counts AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
           length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_case,
           length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
    FROM w LEFT JOIN covered USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 6 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 25 * n_words OR 10 * lettered < 6 * n_words OR 10 * upper_case > 6 * letters) AS kept
FROM failed"""

# All pairs of texts that share a shingle, so for small tables only.
_NEAR = rf"""
WITH RECURSIVE t AS (
    SELECT text, min(doc_id) AS rep,
           regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS ws
    FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (
    SELECT DISTINCT rep, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM t),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(u, v) AS (
    SELECT rep, rep FROM t
    UNION
    SELECT r.u, f.b FROM reach r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) f ON r.v = f.a),
c AS (SELECT u, min(v) AS class_id, count(*) AS n_texts FROM reach GROUP BY u)
SELECT doc_id, class_id, n_texts FROM documents JOIN t USING (text) JOIN c ON u = rep
UNION ALL SELECT doc_id, doc_id, 1 FROM documents WHERE text IS NULL"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in _FIELDS) + ")"


# CRC-32 of the digits of doc_id, bit by bit; the constants are those of the checksum itself.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT),
    lambda c, b: list_reduce(range(8)::UBIGINT[], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END,
                             xor(c, b)), 4294967295::UBIGINT))"""


def _tree(name: str, leaves: str) -> str:
    """Recursion over the levels of a tree's nodes (tree, lvl, place, digest), n nodes in a level."""
    return f"""{name}(tree, lvl, place, digest, n) AS (
    SELECT tree, 0, place, digest, count(*) OVER (PARTITION BY tree) FROM {leaves}
    UNION ALL
    SELECT tree, lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 7) // 8
    FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // 8)"""


def _fold(name: str, start: str, tree: str) -> str:
    """Recursion from (r, tree, place, digest, proof) to the top of its tree."""
    return f"""{name}(r, tree, lvl, place, digest, proof) AS (
    SELECT r, tree, 0, place, digest, proof FROM {start}
    UNION ALL
    SELECT f.r, f.tree, f.lvl + 1, f.place // 8,
           sha256(string_agg(CASE WHEN u.place = f.place THEN f.digest ELSE u.digest END, '' ORDER BY u.place)),
           f.proof || coalesce(string_agg(u.digest, '' ORDER BY u.place) FILTER (WHERE u.place <> f.place), '')
    FROM {name} f JOIN {tree} u ON u.tree = f.tree AND u.lvl = f.lvl AND u.place // 8 = f.place // 8 AND u.n > 1
    GROUP BY f.r, f.tree, f.lvl, f.place, f.digest, f.proof)"""


_MANIFEST = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS changed
    FROM documents),
leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
{_tree("low", "leaves")},
subroots AS (
    SELECT '' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM low WHERE n = 1),
{_tree("high", "subroots")},
low_start AS (SELECT r, tree, place, coalesce(changed, leaf) AS digest, '' AS proof FROM leaves),
{_fold("low_fold", "low_start", "low")},
high_start AS (
    SELECT f.r, '' AS tree, s.place, f.digest, f.proof
    FROM low_fold f JOIN low u ON u.tree = f.tree AND u.lvl = f.lvl AND u.n = 1 JOIN subroots s ON s.lang = f.tree),
{_fold("high_fold", "high_start", "high")}
SELECT doc_id, leaf, s.digest AS subroot, u.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = u.digest AS verified
FROM high_fold f JOIN high u ON u.lvl = f.lvl AND u.n = 1 JOIN leaves USING (r) JOIN subroots s ON s.lang = leaves.tree"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": _QUALITY, "op4_near_dedup": _NEAR, "op12_merkle_manifest": _MANIFEST}
