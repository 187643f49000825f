"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(t) - 3, 1) + 1), lambda i: array_to_string(list_slice(t, i, i + 3), ' '))) AS s FROM words WHERE len(t) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT b.v, r.c FROM reached r JOIN both_ways b ON r.node = b.u),
least_ AS (SELECT node, min(c) AS c FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ l ON l.node = d.doc_id
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, order: int, pattern: str, group: int = 0) -> str:
    return rf"""SELECT doc_id, '{kind}' AS kind, {order} AS o, list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS s, m[i] AS m, v[i] AS v
FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, v FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents))"""


SECRETS = rf"""
WITH base AS (SELECT doc_id, kind, o, s, s + length(m) AS e FROM ({_spans("assign", 0, _ASSIGN, 2)} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+")} UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}")})
WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(m) >= 20 ELSE true END),
runs AS (SELECT doc_id, s, m, s + length(m) AS e FROM ({_spans("entropy", 3, "[A-Za-z0-9+/_=-]{24,}")}) WHERE NOT regexp_matches(m, '(?i)example|sample|dummy|placeholder|lorem|0123456789|abcdefgh')
AND NOT list_bool_or(list_transform(range(1, length(m) - 6), lambda i: lower(substr(m, i, 8)) = repeat(lower(substr(m, i, 1)), 8)))),
free AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND b.e >= r.e)),
windows AS (SELECT doc_id, s, unnest(range(0, length(m) - 23)) AS i, m FROM free),
high AS (SELECT doc_id, s, min(i) AS lo, max(i) AS hi FROM windows WHERE list_entropy(string_split(substr(m, i + 1, 24), '')) >= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN 3.0 WHEN regexp_full_match(m, '[a-z]+|[A-Z]+') THEN 4.4 ELSE 3.9 END - 1e-9 GROUP BY ALL),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, 'entropy', 3, s + lo, s + hi + 24 FROM high),
listed AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN listed USING (doc_id)
"""
