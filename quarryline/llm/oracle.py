"""SQL for the operators that it can express, for DuckDB over the same tables."""

from __future__ import annotations

_COMPONENTS = """
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, other) USING KEY (node) AS (
  SELECT id AS node, id AS other FROM nodes
  UNION
  SELECT node, min(other) AS other FROM (
    SELECT l.a AS node, least(r.other, cur.other) AS other
    FROM reach r JOIN links l ON r.node = l.b JOIN recurring.reach cur ON cur.node = l.a WHERE r.other < cur.other)
  GROUP BY node)"""

OP2 = f"""WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
nodes AS (SELECT vec_id AS id FROM v),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
{_COMPONENTS}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, other AS component_id, node = other AS kept FROM reach"""

OP3 = f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
nodes AS (SELECT doc_id AS id FROM sets),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
{_COMPONENTS}
SELECT node AS doc_id, len(s) AS n_shingles, other AS component_id FROM reach JOIN sets ON doc_id = node"""

# The base patterns as given. The kinds that the method adds (iban, ssn) need looks around a match, which DuckDB's
# expressions lack; none of them occurs in the generated documents, and tests cover them by brute force.
_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for rank, (kind, p) in enumerate(_BASE)
)
OP4 = f"""WITH
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT * FROM ({_FOUND}) WHERE len(m) > 0),
each AS (SELECT doc_id, rank, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, rank, kind, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
         CAST(sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM each),
kept AS (
  SELECT doc_id, rank, kind, stop - length(x) AS start, stop FROM placed WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda o: length(ltrim(o, '0')) > 3 OR CAST('0' || right(ltrim(o, '0'), 4) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(digits), k, 1) AS INTEGER)
           ELSE CAST(substr(reverse(digits), k, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(reverse(digits), k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE true END),
texts AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN texts USING (doc_id)"""

ORACLE_SQL = {"op2_covertree": OP2, "op3_jaccard": OP3, "op4_pii": OP4}
