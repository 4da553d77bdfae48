"""The queries of the retrieval engine and the SQL that checks them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import chunking, formatting, highlight, text, tokens
from ..operators import batching, diff, embedding, retrieval, views
from ..sources import ignore
from . import fixtures as X
from .oracle import ORACLE_SQL  # noqa: F401

PATTERNS = ("node_modules", "/dir0", "dir1/f1*", "**/f2?.md", "*.tsx", "dir3/", "!keep.md", "[", "dir4/**", "f[0-9].mm")
PACK_BYTES, PACK_FILES = 64 << 10, 20
K, RECALL = 5, 30


def scan_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir)
    return f.select("relative_path", text.language_of(F.col("relative_path")).alias("language"), text.admitted(F.col("relative_path"), F.col("size"), 8192).alias("admitted"))


def path_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("relative_path", ignore.path_ignored(F.col("relative_path"), PATTERNS).alias("ignored"))


def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("content").cast("binary")
    return X.files(spark, sf_dir).select("doc_id", F.sha2(raw, 256).alias("sha256"), F.is_valid_utf8("content").alias("valid"), text.looks_binary(raw).alias("looks_binary"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = X.files(spark, sf_dir).select("codebase_id", "relative_path", "sha256", "size", "mtime_ns")
    return diff.file_diff(scan, X.stored_manifest(spark, sf_dir))


def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("codebase_id", "relative_path", "sha256", "size", "status")


def file_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_report(_diff(spark, sf_dir))


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = X.files(spark, sf_dir).select("codebase_id", "relative_path", "size", "mtime_ns")
    return diff.suspects(scan, X.stored_manifest(spark, sf_dir)).select("codebase_id", "relative_path")


def next_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.next_manifest(_diff(spark, sf_dir))


def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = batching.pack_files(X.files(spark, sf_dir).select("codebase_id", "relative_path", "size"), PACK_BYTES, PACK_FILES)
    return packed.select("codebase_id", "relative_path", "size", F.col("batch").cast("bigint").alias("batch"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir)
    return f.select("doc_id", text.token_estimate(F.col("content")).alias("tokens"), text.token_estimate(F.col("content"), 1).alias("tokens_plus"), batching.fixed_batches(F.col("doc_id")).alias("batch"))


def chunk_whole_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_files(X.files(spark, sf_dir).where("size <= 4096").select("relative_path", "content"))
    return found.select("relative_path", "start_line", "end_line", "language", F.octet_length("content").cast("bigint").alias("bytes"))


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_files(X.files(spark, sf_dir).select("relative_path", "content"))
    return found.select("relative_path", "ordinal", "start_line", "end_line", "language", F.sha2("content", 256).alias("chunk_hash"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_lines(X.files(spark, sf_dir).select("relative_path", "content"), 1000, 0)
    return found.select("relative_path", F.col("ordinal").cast("bigint").alias("ordinal"), F.sha2("content", 256).alias("chunk_hash"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def chunk_lines_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_lines(X.files(spark, sf_dir).select("relative_path", "content"), 5000, 300)
    return found.select("relative_path", "ordinal", "start_line", "end_line", F.sha2("content", 256).alias("chunk_hash"))


def drop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = X.files(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("piece", "content"))
    return pieces.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.coalesce(text.drop_reason(F.col("content"), 60), F.lit("keep")).alias("reason"))


def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_reason(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.files(spark, sf_dir).select("relative_path", text.chunk_hash(F.col("content")).alias("chunk_hash"), F.octet_length("content").cast("bigint").alias("bytes"))
    return h.withColumn("id", text.chunk_id(F.col("relative_path"), F.col("chunk_hash")))


def collection_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = X.files(spark, sf_dir).select("codebase_id").distinct()
    return ids.select("codebase_id", text.collection_name(F.col("codebase_id"), X.PREFIX).alias("collection"), text.codebase_id(F.concat(F.lit("/src/"), "codebase_id")).alias("derived_id"))


def last_of_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.new_chunks(spark, sf_dir).select("collection", "relative_path", F.posexplode(F.split("content", "\n")).alias("ordinal", "line"))
    kept = diff.last_of_equals(lines.withColumn("chunk_hash", text.chunk_hash(F.col("line"))))
    return kept.select("relative_path", "chunk_hash", F.col("ordinal").cast("bigint").alias("ordinal"))


def _chunk_diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    new = X.new_chunks(spark, sf_dir)
    pushed = new.select("collection", "relative_path")
    return diff.chunk_diff(new, X.stored_chunks(spark, sf_dir), pushed), pushed


def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_diff(spark, sf_dir)[0].select("relative_path", "chunk_hash", "status")


def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.upsert_stats(*_chunk_diff(spark, sf_dir))


def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = X.stored_chunks(spark, sf_dir)
    stay, go = diff.delete_files(stored, stored.where("language = 'python'").select("collection", "relative_path"))
    return stay.select("id", F.lit("stays").alias("fate")).unionByName(go.select("id", F.lit("goes").alias("fate")))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.new_chunks(spark, sf_dir)
    return c.select("doc_id", F.size(tokens.tokens(F.col("content"))).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tokens.tokens(F.col("content")))).cast("bigint").alias("n_distinct"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(X.new_chunks(spark, sf_dir)).select("chunk_id", "token", "tf")


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings_stats(retrieval.postings(X.new_chunks(spark, sf_dir)))


def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_lookup(X.one_query(spark, sf_dir), retrieval.postings(X.new_chunks(spark, sf_dir))).select("chunk_id", "tf")


def _hits(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    return retrieval.vector_hits(queries, X.indexed_chunks(spark, sf_dir).where("vector is not null"), RECALL)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, X.one_query(spark, sf_dir)).select("chunk_id", F.round("cos", 6).alias("cos"))


def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", retrieval.valid_vector(F.col("embedding"), 64).alias("valid"), retrieval.valid_vector(F.slice("embedding", 1, 63), 64).alias("valid_short"))


def keyword_only_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.one_query(spark, sf_dir)
    found = retrieval.keyword_lookup(q, retrieval.postings(X.new_chunks(spark, sf_dir)))
    return retrieval.keyword_only(found, _hits(spark, sf_dir, q)).select("chunk_id", F.round("score", 6).alias("score"), "tf")


def _hybrid(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    chunks = X.indexed_chunks(spark, sf_dir)
    pool = chunks.where("vector is not null")
    config = EngineConfig()
    hits = retrieval.vector_hits(queries, pool, config.recall(k))
    return retrieval.hybrid_of(queries, chunks, hits, retrieval.keyword_scan(queries, chunks), k, config)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hybrid(spark, sf_dir, X.one_query(spark, sf_dir), 10)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "relative_path", "language")


def hybrid_search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hybrid(spark, sf_dir, X.many_queries(spark, sf_dir), K)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.list_indexes(X.codebase_chunks(spark, sf_dir), X.registry(spark, sf_dir), X.PREFIX)


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.language_histogram(X.codebase_chunks(spark, sf_dir))


def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = views.language_share(language_histogram(spark, sf_dir))
    return shares.select("collection", "language", "n_chunks", "percent", F.col("rank").cast("bigint").alias("rank"), "n_more")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    remembered = X.files(spark, sf_dir).select("codebase_id").distinct().where("codebase_id in ('src1', 'src3', 'src12')")
    return views.resolve_indexes(list_indexes(spark, sf_dir), remembered, X.PREFIX)


def resolve_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.listed(_resolved(spark, sf_dir)).withColumn("position", F.col("position").cast("bigint"))


def default_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.default_index(_resolved(spark, sf_dir))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.in_scope(_resolved(spark, sf_dir), " SRC1 ").select("id", "num_chunks", "exact")


def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.recent_searches(X.query_log(spark, sf_dir))


def remembered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = X.query_log(spark, sf_dir)
    return views.remembered_ids(log, log.where("codebase_id = 'cb-3'"))


def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.result_text(_hybrid(spark, sf_dir, X.one_query(spark, sf_dir), K))


def copy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.copy_all(_hybrid(spark, sf_dir, X.one_query(spark, sf_dir), K))


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hybrid(spark, sf_dir, X.one_query(spark, sf_dir), K)
    return found.select(F.col("rank").cast("bigint").alias("rank"), F.to_json(F.struct("relative_path", "start_line", "end_line", "language")).alias("json"))


def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir)
    line = formatting.preview(F.col("content"))
    return f.select("doc_id", line.alias("preview"), (F.octet_length("content") <= 160).alias("short"))


def content_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("doc_id", F.sha2(text.truncated(F.col("content"), 100), 256).alias("sha256"))


def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero bytes at the start, at the last place that is looked at, and behind it."""
    content, kind, zero = F.col("content"), F.col("doc_id") % 4, F.lit("\x00")
    made = F.when(kind == 0, F.concat(F.left(content, F.lit(10)), zero, content))
    for k, n in ((1, 8191), (2, 8192)):
        made = made.when(kind == k, F.concat(F.repeat(F.lit("x"), F.lit(n)), zero, content))
    return X.files(spark, sf_dir).select("doc_id", text.looks_binary(made.otherwise(content).cast("binary")).alias("looks_binary"))


def tokens_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.postings(X.table(spark, sf_dir, "documents").select("doc_id", X.camel(F.col("text")).alias("content")))


def drop_reason_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.code_chunks(spark, sf_dir).select("doc_id", F.coalesce(text.drop_reason(F.col("content")), F.lit("keep")).alias("reason"))


def merge_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every file as chunks, small ones merged."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                lines = [(line, n, n) for n, line in enumerate((content or "").encode().split(b"\n"), 1)]
                rows += [(doc_id, first, last, len(raw)) for raw, first, last in chunking.merge_small(lines, 4000)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_line", "end_line", "bytes"])

    return X.files(spark, sf_dir).select("doc_id", "content").mapInPandas(run, "doc_id long, start_line long, end_line long, bytes long")


def score_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("event_id", (F.pmod(F.col("event_id"), F.lit(101)) / 100).alias("score"))
    return e.select("event_id", formatting.score_tone(F.col("score")).alias("tone"), formatting.score_percent(F.col("score")).alias("percent"))


def pretty_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = X.files(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, F.concat("codebase_id", F.lit("-150babfd"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "codebase_id")).otherwise(F.col("codebase_id")).alias("id")).distinct()
    name, tail = formatting.pretty_id(F.col("id"))
    return ids.select("id", name.alias("name"), tail.alias("hash"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("relative_path", text.dir_name(F.col("relative_path")).alias("dir"), text.base_name(F.col("relative_path")).alias("file"))


def line_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("doc_id", F.sha2(formatting.clamped(F.col("content"), 4, 6), 256).alias("shown"))


def language_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, colour = formatting.language_label(F.col("language"))
    return X.new_chunks(spark, sf_dir).select("language").distinct().select("language", name.alias("name"), colour.alias("colour"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir).withColumn("n", F.when(F.col("doc_id") % 3 == 0, F.col("size") * 1000).otherwise(F.col("size")))
    return f.select("doc_id", formatting.human_bytes(F.col("n")).alias("bytes"), formatting.human_duration(F.col("n") / 7).alias("duration"))


def embed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding.embed_table(X.files(spark, sf_dir).select("doc_id", "content"), embedding.Hashing(64))
    return found.select("doc_id", F.size("vector").alias("dim"), F.round(retrieval.dot(F.col("vector"), F.col("vector")), 4).alias("norm"))


def highlight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each class the highlighter finds in a file."""
    highlight.register(spark)
    X.new_chunks(spark, sf_dir).createOrReplaceTempView("quarryline_chunks")
    rows = spark.sql("SELECT c.doc_id, h.class FROM quarryline_chunks c, LATERAL highlight(c.content, c.language) h")
    return rows.groupBy("doc_id", "class").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_admit, path_ignore, file_hash, file_diff, file_diff_report, suspects, next_manifest, batch_pack, token_estimate, chunk_whole_file, chunk_files,
        chunk_lines, chunk_lines_overlap, drop_reason, drop_reason_counts, chunk_identity, collection_name, last_of_equals, chunk_diff, upsert_stats, delete_files,
        postings, postings_stats, keyword_lookup, cosine_topk, vector_validate, keyword_only_candidates, hybrid_search, hybrid_search_multi, list_indexes,
        language_histogram, language_share, resolve_indexes, default_index, scope_filter, recent_searches, remembered_ids, result_text, copy_all, result_json, result_preview,
        score_tone, pretty_id, path_parts, line_clamp, language_display, human_sizes, embed_hashing, highlight_classes,
        content_truncate, binary_sniff, tokens_camel, drop_reason_code, merge_small_chunks,
    )
} | {"tokens": token_rows}
