"""SQL that gives the same rows as the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.text import ADMITTED, DISPLAY, LANGUAGES, OTHER_COLOUR, OTHER_NAME
from ..functions.tokens import STOP_WORDS
from . import fixtures as X

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_EXT = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(X.EXTENSIONS))
_SUFFIX = r"regexp_extract(relative_path, '(\.[^./]*)$', 1)"
_LANGUAGE = f"CASE WHEN length(relative_path) > length({_SUFFIX}) THEN CASE {_SUFFIX} " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in LANGUAGES.items()) + " ELSE 'unknown' END ELSE 'unknown' END"
_SCOPE = f"'{X.PREFIX}' || substr(sha256('{X.SCOPE}'), 1, 24)"

FILES = f"""
files AS (
  SELECT source AS codebase_id, doc_id, 'dir' || (doc_id % 5) || '/f' || doc_id || CASE doc_id % 8 {_EXT} END AS relative_path,
         text AS content, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, 1704067200000000000 + doc_id * 1000000000 AS mtime_ns
  FROM documents)"""
MANIFEST = """
stored_manifest AS (
  SELECT codebase_id, relative_path, CASE WHEN doc_id % 7 = 0 THEN sha256(content || 'x') ELSE sha256 END AS sha256,
         CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size,
         CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns
  FROM files WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT codebase_id, 'gone/' || relative_path, sha256, size, mtime_ns FROM files WHERE doc_id % 10 = 1)"""
CHUNKS = f"""
chunks AS (
  SELECT {_SCOPE} AS collection, substr(sha256(relative_path || ':' || sha256), 1, 32) AS id, sha256 AS chunk_hash, content, relative_path, 1 AS start_line,
         CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS end_line, {_LANGUAGE} AS language, doc_id, codebase_id
  FROM files)"""
STORED = """
stored AS (
  SELECT *, CASE WHEN doc_id % 7 = 0 THEN sha256(content || 'x') ELSE chunk_hash END AS old_hash FROM chunks WHERE doc_id % 10 <> 0),
stored_chunks AS (
  SELECT collection, substr(sha256(relative_path || ':' || old_hash), 1, 32) AS id, old_hash AS chunk_hash, relative_path, language FROM stored)"""
DIFF = """
file_diff AS (
  SELECT coalesce(s.codebase_id, m.codebase_id) AS codebase_id, coalesce(s.relative_path, m.relative_path) AS relative_path,
         CASE WHEN s.size = m.size AND s.mtime_ns = m.mtime_ns THEN m.sha256 ELSE coalesce(s.sha256, m.sha256) END AS sha256,
         coalesce(s.size, m.size) AS size, coalesce(s.mtime_ns, m.mtime_ns) AS mtime_ns,
         CASE WHEN s.relative_path IS NULL THEN 'removed' WHEN s.size = m.size AND s.mtime_ns = m.mtime_ns THEN 'unchanged'
              WHEN m.relative_path IS NULL THEN 'added' WHEN s.sha256 <> m.sha256 THEN 'modified' ELSE 'unchanged_touched' END AS status
  FROM files s FULL JOIN stored_manifest m ON s.codebase_id = m.codebase_id AND s.relative_path = m.relative_path)"""


def _keep(x: str) -> str:
    return f"(length({x}) >= 3 AND regexp_replace({x}, '^@', '') NOT IN ({_quoted(STOP_WORDS)}))"


def tokens_of(source: str, key: str, content: str) -> str:
    """CTEs ending in {source}_tokens(key, token), a row for each occurrence."""
    return f"""
{source}_found AS (SELECT {key}, unnest(regexp_extract_all({content}, '@?[A-Za-z][A-Za-z0-9_]{{2,}}')) AS f FROM {source}),
{source}_raw AS (
  SELECT {key}, lower(f) AS raw, regexp_replace(lower(f), '^@', '') AS body,
         string_split(regexp_replace(regexp_replace(regexp_replace(f, '^@', ''), '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][^A-Z])', '\\1 \\2', 'g'), ' ') AS parts
  FROM {source}_found WHERE {_keep("lower(f)")}),
{source}_parts AS (SELECT {key}, raw, body, lower(unnest(parts)) AS part FROM {source}_raw),
{source}_tokens AS (
  SELECT {key}, raw AS token FROM {source}_raw
  UNION ALL SELECT {key}, part FROM {source}_parts WHERE part <> body AND part <> raw AND {_keep("part")})"""


CHUNK_TOKENS = tokens_of("chunks", "id", "content")
POSTINGS = CHUNK_TOKENS + ",\npostings AS (SELECT id AS chunk_id, token, count(*) AS tf FROM chunks_tokens GROUP BY ALL)"
ONE = f"one_query AS (SELECT CAST(0 AS BIGINT) AS query_id, '{X.QUERY}' AS query, embedding AS query_vector FROM embeddings ORDER BY vec_id LIMIT 1)"
MANY = "one_query AS (SELECT item_id AS query_id, text AS query, embedding AS query_vector FROM benchmark JOIN embeddings ON item_id = vec_id)"


def ranking(queries: str, k: int) -> str:
    """CTEs ending in ranked: the hybrid ranking of one_query over chunks."""
    return f"""{FILES}, {CHUNKS}, {POSTINGS}, {queries},
{tokens_of("one_query", "query_id", "query")},
kw AS (
  SELECT query_id, chunk_id, CAST(sum(tf) AS BIGINT) AS tf
  FROM (SELECT DISTINCT query_id, token FROM one_query_tokens) JOIN postings USING (token) GROUP BY ALL),
scored AS (
  SELECT query_id, id AS chunk_id,
         list_dot_product(CAST(query_vector AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(query_vector AS DOUBLE[]), CAST(query_vector AS DOUBLE[])))
         * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS cos
  FROM one_query, chunks JOIN embeddings ON doc_id = vec_id),
hits AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id) <= greatest(30, 3 * {k})),
kw_only AS (
  SELECT query_id, chunk_id, tf, least(0.30::DOUBLE + 0.015::DOUBLE * tf, 0.50::DOUBLE) AS score FROM kw ANTI JOIN hits USING (query_id, chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, chunk_id) <= 200),
pool AS (
  SELECT query_id, chunk_id, cos + least(0.02::DOUBLE * coalesce(tf, 0), 0.20::DOUBLE) AS score FROM hits LEFT JOIN kw USING (query_id, chunk_id)
  UNION ALL SELECT query_id, chunk_id, score FROM kw_only),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pool JOIN chunks ON chunk_id = id QUALIFY rank <= {k})"""


_PACK = """
r AS (SELECT codebase_id, relative_path, size, row_number() OVER (PARTITION BY codebase_id ORDER BY relative_path) AS rn FROM files),
p AS (
  SELECT codebase_id, relative_path, size, rn, size AS bytes, 1 AS items, CAST(0 AS BIGINT) AS batch FROM r WHERE rn = 1
  UNION ALL
  SELECT r.codebase_id, r.relative_path, r.size, r.rn,
         CASE WHEN p.bytes + r.size > 65536 OR p.items >= 20 THEN r.size ELSE p.bytes + r.size END,
         CASE WHEN p.bytes + r.size > 65536 OR p.items >= 20 THEN 1 ELSE p.items + 1 END,
         p.batch + CASE WHEN p.bytes + r.size > 65536 OR p.items >= 20 THEN 1 ELSE 0 END
  FROM p JOIN r ON r.codebase_id = p.codebase_id AND r.rn = p.rn + 1)"""
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_STARTS = lambda x, *ps: "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in ps) + ")"
_IMPORT = f"""({_STARTS("x", "import ", "import(", "using ", "require ", "require(")} OR (starts_with(x, 'from ') AND contains(x, ' import '))
  OR ({_STARTS("x", "use ", "package ")} AND ends_with(x, ';')) OR x IN ('(', ')', '{{', '}}'))"""
_COMMENT = _STARTS("x", "//", "#", "*", "/*", "<!--")
_REASONS = f"""
parts AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM files),
pieces AS (SELECT doc_id, unnest(l) AS content, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS piece FROM parts),
bodies AS (SELECT doc_id, piece, {_TRIM("content")} AS body FROM pieces),
lined AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_TRIM("x")}), lambda x: x <> '') AS lines FROM bodies),
coded AS (SELECT *, list_filter(lines, lambda x: NOT {_STARTS("x", "//", "#")}) AS code FROM lined),
reasons AS (
  SELECT doc_id, piece, CASE WHEN body = '' THEN 'blank' WHEN strlen(body) < 60 THEN 'short'
    WHEN len(code) > 0 AND len(list_filter(code, lambda x: NOT {_IMPORT})) = 0 THEN 'imports'
    WHEN len(lines) > 0 AND len(list_filter(lines, lambda x: NOT {_COMMENT})) = 0 THEN 'comments' ELSE 'keep' END AS reason
  FROM coded)"""
_JUDGED = _REASONS[_REASONS.index("lined AS") :].replace("doc_id, piece,", "doc_id,").replace("strlen(body) < 60", "strlen(body) < 100")
_ONE_LINE = "replace(left(text, 60), chr(10), ' ') || ' ' || repeat('z', 40)"
_CODE = f"""code AS (SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN 'import ' || {_ONE_LINE} || chr(10) || chr(10) || 'from a import ' || {_ONE_LINE} || chr(10) || 'use b::c;' || chr(10) || '(' || chr(10)
  WHEN 1 THEN '# ' || {_ONE_LINE} || chr(10) || '  // ' || {_ONE_LINE} || chr(10) || '/* a */' || chr(10) || '* b' || chr(10)
  WHEN 2 THEN 'import x' || chr(10) || '# ' || left(source, 20) WHEN 3 THEN '# ' || {_ONE_LINE} || chr(10) || 'import ' || {_ONE_LINE}
  WHEN 4 THEN 'package ' || {_ONE_LINE} || chr(10) || 'import ' || {_ONE_LINE} ELSE text END AS content FROM documents)"""
_BINARY = "CASE doc_id % 4 WHEN 0 THEN left(text, 10) || chr(0) || text WHEN 1 THEN repeat('x', 8191) || chr(0) || text WHEN 2 THEN repeat('x', 8192) || chr(0) || text ELSE text END"
_CAMEL = "camel AS (SELECT doc_id, replace(replace(replace(replace(replace(text, ' t', 'T'), ' a', 'A'), ' e', 'E'), ' d', 'D'), ' s', 'S') AS content FROM documents)"
_MERGED = """
parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, strlen(unnest(l)) AS len, CAST(generate_subscripts(l, 1) AS BIGINT) AS rn FROM parts),
p AS (
  SELECT doc_id, rn, len, len AS size, CAST(0 AS BIGINT) AS part FROM r WHERE rn = 1
  UNION ALL
  SELECT r.doc_id, r.rn, r.len, CASE WHEN p.size < 1000 AND p.size + r.len <= 4000 THEN p.size + 1 + r.len ELSE r.len END,
         p.part + CASE WHEN p.size < 1000 AND p.size + r.len <= 4000 THEN 0 ELSE 1 END
  FROM p JOIN r ON r.doc_id = p.doc_id AND r.rn = p.rn + 1)"""
_CUT = lambda x, n: f"left({x}, list_max(list_transform(range(0, {n + 1}), lambda k: CASE WHEN strlen(left({x}, k)) <= {n} THEN k ELSE 0 END)))"
_CHUNK_DIFF = """
chunk_diff AS (
  SELECT coalesce(n.relative_path, o.relative_path) AS relative_path, coalesce(n.chunk_hash, o.chunk_hash) AS chunk_hash,
         CASE WHEN o.chunk_hash IS NULL THEN 'inserted' WHEN n.chunk_hash IS NULL THEN 'deleted' ELSE 'reused' END AS status
  FROM (SELECT DISTINCT relative_path, chunk_hash FROM chunks) n FULL JOIN stored_chunks o ON n.relative_path = o.relative_path AND n.chunk_hash = o.chunk_hash)"""
_IGNORED = r"""regexp_matches(relative_path, '(^|/)node_modules(/|$)') OR regexp_matches(relative_path, '^dir0(/|$)') OR regexp_matches(relative_path, '(^|/)dir1/f1[^/]*(/|$)')
  OR regexp_matches(relative_path, '(^|/)f2[^/]\.md(/|$)') OR regexp_matches(relative_path, '(^|/)[^/]*\.tsx(/|$)') OR regexp_matches(relative_path, '(^|/)dir3(/|$)')
  OR regexp_matches(relative_path, '(^|/)!keep\.md(/|$)') OR regexp_matches(relative_path, '(^|/)dir4(/|$)') OR regexp_matches(relative_path, '(^|/)f[0-9]\.mm(/|$)')"""
_COLLECTION = f"'{X.PREFIX}' || substr(sha256(codebase_id), 1, 24)"
INDEXES = f"""
owned AS (SELECT {_COLLECTION} AS collection, codebase_id, language FROM chunks),
indexes AS (
  SELECT collection, CASE WHEN length(any_value(codebase_id)) > 4 THEN any_value(codebase_id) ELSE '' END AS codebase_id, count(*) AS num_chunks FROM owned GROUP BY collection),
histogram AS (SELECT collection, language, count(*) AS n_chunks FROM owned GROUP BY ALL),
remembered AS (SELECT DISTINCT codebase_id AS remembered_id, {_COLLECTION} AS collection FROM files WHERE codebase_id IN ('src1', 'src3', 'src12')),
resolved AS (
  SELECT collection, coalesce(nullif(codebase_id, ''), remembered_id, '') AS id, coalesce(nullif(codebase_id, ''), remembered_id) IS NOT NULL AS named, num_chunks
  FROM indexes LEFT JOIN remembered USING (collection))"""
LOG = "query_log AS (SELECT 'cb-' || (user_id % 5) AS codebase_id, event_type || ' ' || (user_id % 3) AS query, ts FROM events)"
_DISPLAY = " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in DISPLAY.items()), " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in DISPLAY.items())


def _with(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{select}"


_LINES = "string_agg(printf('%6d  %s', CAST(start_line + i AS INTEGER), line) || chr(10), '' ORDER BY i)"
ORACLE_SQL: dict[str, str] = {
    "scan_admit": _with(FILES, select=f"SELECT relative_path, {_LANGUAGE} AS language, lower({_SUFFIX}) IN ({_quoted(ADMITTED)}) AND size <= 8192 AS admitted FROM files"),
    "path_ignore": _with(FILES, select=f"SELECT relative_path, {_IGNORED} AS ignored FROM files"),
    "file_hash": "SELECT doc_id, sha256(text) AS sha256, true AS valid, contains(text[:8192], chr(0)) AS looks_binary FROM documents",
    "file_diff": _with(FILES, MANIFEST, DIFF, select="SELECT codebase_id, relative_path, sha256, size, status FROM file_diff"),
    "file_diff_report": _with(FILES, MANIFEST, DIFF, select="SELECT status, count(*) AS n_files FROM file_diff GROUP BY status"),
    "suspects": _with(FILES, MANIFEST, select="SELECT codebase_id, relative_path FROM files f WHERE NOT EXISTS (FROM stored_manifest m WHERE m.codebase_id = f.codebase_id AND m.relative_path = f.relative_path AND m.size = f.size AND m.mtime_ns = f.mtime_ns)"),
    "next_manifest": _with(FILES, MANIFEST, DIFF, select="SELECT codebase_id, relative_path, sha256, size, mtime_ns FROM file_diff WHERE status <> 'removed'"),
    "batch_pack": _with(FILES, _PACK, select="SELECT codebase_id, relative_path, size, batch FROM p", recursive=True),
    "token_estimate": "SELECT doc_id, CAST(greatest(strlen(text) // 3, 1) AS BIGINT) AS tokens, CAST(greatest(strlen(text) // 3 + 1, 1) AS BIGINT) AS tokens_plus, CAST(doc_id // 100 AS BIGINT) AS batch FROM documents",
    "chunk_whole_file": _with(FILES, CHUNKS, select=f"SELECT relative_path, start_line, end_line, language, CAST(strlen(content) AS BIGINT) AS bytes FROM chunks WHERE strlen(content) <= 4096 AND {_TRIM('content')} <> ''"),
    "drop_reason": _with(FILES, _REASONS, select="SELECT * FROM reasons"),
    "drop_reason_counts": _with(FILES, _REASONS, select="SELECT reason, count(*) AS n FROM reasons GROUP BY reason"),
    "chunk_identity": _with(FILES, CHUNKS, select="SELECT relative_path, chunk_hash, CAST(strlen(content) AS BIGINT) AS bytes, id FROM chunks"),
    "collection_name": _with(FILES, select=f"SELECT DISTINCT codebase_id, {_COLLECTION} AS collection, codebase_id || '-' || substr(sha256('/src/' || codebase_id), 1, 8) AS derived_id FROM files"),
    "last_of_equals": _with(FILES, "l AS (SELECT relative_path, string_split(content, chr(10)) AS l FROM files)", select="SELECT relative_path, sha256(line) AS chunk_hash, max(ordinal) AS ordinal FROM (SELECT relative_path, unnest(l) AS line, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS ordinal FROM l) GROUP BY ALL"),
    "chunk_diff": _with(FILES, CHUNKS, STORED, _CHUNK_DIFF, select="SELECT * FROM chunk_diff"),
    "upsert_stats": _with(FILES, CHUNKS, STORED, _CHUNK_DIFF, select="SELECT (SELECT count(*) FROM files) AS files_processed, count(*) FILTER (status <> 'deleted') AS chunks_processed, count(*) FILTER (status = 'inserted') AS chunks_new_embedded, count(*) FILTER (status = 'reused') AS chunks_reused, count(*) FILTER (status = 'deleted') AS chunks_deleted FROM chunk_diff"),
    "delete_files": _with(FILES, CHUNKS, STORED, select="SELECT id, CASE WHEN language = 'python' THEN 'goes' ELSE 'stays' END AS fate FROM stored_chunks"),
    "tokens": _with(FILES, tokens_of("files", "doc_id", "content"), select="SELECT doc_id, count(token) AS n_tokens, count(DISTINCT token) AS n_distinct FROM files LEFT JOIN files_tokens USING (doc_id) GROUP BY doc_id"),
    "postings": _with(FILES, CHUNKS, POSTINGS, select="SELECT chunk_id, token, tf FROM postings"),
    "postings_stats": _with(FILES, CHUNKS, POSTINGS, select=f"SELECT {_SCOPE} AS collection, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT token) AS n_tokens, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM postings"),
    "keyword_lookup": _with(ranking(ONE, 5), select="SELECT chunk_id, tf FROM kw"),
    "cosine_topk": _with(ranking(ONE, 5), select="SELECT chunk_id, round(cos, 6) AS cos FROM hits"),
    "vector_validate": "SELECT vec_id, len(embedding) = 64 AS valid, false AS valid_short FROM embeddings",
    "keyword_only_candidates": _with(ranking(ONE, 5), select="SELECT chunk_id, round(score, 6) AS score, tf FROM kw_only"),
    "hybrid_search": _with(ranking(ONE, 10), select="SELECT rank, chunk_id, round(score, 6) AS score, relative_path, language FROM ranked"),
    "hybrid_search_multi": _with(ranking(MANY, 5), select="SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked"),
    "list_indexes": _with(FILES, CHUNKS, INDEXES, select="SELECT * FROM indexes"),
    "language_histogram": _with(FILES, CHUNKS, INDEXES, select="SELECT * FROM histogram"),
    "language_share": _with(FILES, CHUNKS, INDEXES, select="SELECT collection, language, n_chunks, CAST(floor(n_chunks * 100 / sum(n_chunks) OVER (PARTITION BY collection) + 0.5) AS BIGINT) AS percent, row_number() OVER (PARTITION BY collection ORDER BY n_chunks DESC, language) AS rank, greatest(count(*) OVER (PARTITION BY collection) - 3, 0) AS n_more FROM histogram QUALIFY rank <= 3"),
    "resolve_indexes": _with(FILES, CHUNKS, INDEXES, select="SELECT *, row_number() OVER (ORDER BY named DESC, num_chunks DESC, collection) AS position FROM resolved"),
    "default_index": _with(FILES, CHUNKS, INDEXES, select="SELECT id, num_chunks FROM resolved WHERE named ORDER BY num_chunks DESC, id LIMIT 1"),
    "scope_filter": _with(FILES, CHUNKS, INDEXES, select="SELECT id, num_chunks, id = 'SRC1' AS exact FROM resolved WHERE contains(lower(id), 'src1')"),
    "recent_searches": _with(LOG, select="SELECT codebase_id, query, max(ts) AS ts FROM query_log GROUP BY ALL ORDER BY ts DESC, codebase_id, query LIMIT 8"),
    "remembered_ids": _with(LOG, select="SELECT codebase_id, max(ts) AS last_used FROM query_log WHERE codebase_id <> 'cb-3' GROUP BY codebase_id"),
    "result_text": _with(
        ranking(ONE, 5),
        "split AS (SELECT rank, relative_path, start_line, string_split(content, chr(10)) AS l FROM ranked)",
        "numbered AS (SELECT rank, relative_path, start_line, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM split)",
        f"blocks AS (SELECT rank, 'Path: ' || relative_path || chr(10) || {_LINES} AS block FROM numbered GROUP BY rank, relative_path)",
        select="SELECT 'The following code sections were retrieved:' || chr(10) || string_agg(block, '...' || chr(10) || chr(10) ORDER BY rank) AS text FROM blocks",
    ),
    "copy_all": _with(ranking(ONE, 5), select="SELECT string_agg('// ' || relative_path || ':' || start_line || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS text FROM ranked"),
    "result_json": _with(ranking(ONE, 5), select="SELECT rank, CAST(to_json({'relative_path': relative_path, 'start_line': start_line, 'end_line': end_line, 'language': language}) AS VARCHAR) AS json FROM ranked"),
    "result_preview": f"WITH l AS (SELECT doc_id, text, replace(text, chr(10), ' ⏎ ') AS line FROM documents) SELECT doc_id, CASE WHEN strlen(line) <= 160 THEN line ELSE {_CUT('line', 160)} || '...' END AS preview, strlen(text) <= 160 AS short FROM l",
    "content_truncate": f"SELECT doc_id, sha256(CASE WHEN strlen(text) <= 100 THEN text ELSE {_CUT('text', 100)} || CASE WHEN strlen({_CUT('text', 100)}) < 100 THEN '�' ELSE '' END END) AS sha256 FROM documents",
    "binary_sniff": f"WITH b AS (SELECT doc_id, {_BINARY} AS content FROM documents) SELECT doc_id, contains(content, chr(0)) AND strlen(split_part(content, chr(0), 1)) < 8192 AS looks_binary FROM b",
    "tokens_camel": _with(_CAMEL, tokens_of("camel", "doc_id", "content"), select="SELECT doc_id, token, count(*) AS tf FROM camel_tokens GROUP BY ALL"),
    "drop_reason_code": _with(_CODE, f"bodies AS (SELECT doc_id, {_TRIM('content')} AS body FROM code)", _JUDGED, select="SELECT doc_id, reason FROM reasons"),
    "merge_small_chunks": _with(_MERGED, select="SELECT doc_id, min(rn) AS start_line, max(rn) AS end_line, CAST(sum(len) + count(*) - 1 AS BIGINT) AS bytes FROM p GROUP BY doc_id, part", recursive=True),
    "score_tone": "SELECT event_id, CASE WHEN event_id % 101 >= 80 THEN 'high' WHEN event_id % 101 >= 60 THEN 'medium' ELSE 'low' END AS tone, CAST(event_id % 101 AS BIGINT) AS percent FROM events",
    "pretty_id": _with(
        FILES,
        "ids AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN codebase_id || '-150babfd' WHEN 1 THEN '-' || codebase_id ELSE codebase_id END AS id FROM files)",
        select="SELECT id, CASE WHEN regexp_extract(id, '^(.+)-([^-]+)$', 1) = '' THEN id ELSE regexp_extract(id, '^(.+)-([^-]+)$', 1) END AS name, regexp_extract(id, '^(.+)-([^-]+)$', 2) AS hash FROM ids",
    ),
    "path_parts": _with(FILES, select="SELECT relative_path, regexp_extract(relative_path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(relative_path, '([^/]*)$', 1) AS file FROM files"),
    "line_clamp": "SELECT doc_id, sha256(CASE WHEN len(string_split(text, chr(10))) > 6 THEN array_to_string(string_split(text, chr(10))[1:4], chr(10)) ELSE text END) AS shown FROM documents",
    "language_display": _with(FILES, CHUNKS, select=f"SELECT DISTINCT language, CASE language {_DISPLAY[0]} WHEN 'other' THEN '{OTHER_NAME}' ELSE language END AS name, CASE language {_DISPLAY[1]} ELSE '{OTHER_COLOUR}' END AS colour FROM chunks"),
    "human_sizes": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strlen(text) * 1000 ELSE strlen(text) END AS n FROM documents), t AS (SELECT *, CAST(floor(n / 7 + 0.5) AS BIGINT) AS s FROM s)
      SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024) ELSE n || ' B' END AS bytes,
             CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration FROM t""",
}
