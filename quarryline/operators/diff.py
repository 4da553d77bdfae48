"""Differences: files against a manifest, chunks against stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE_KEY = ["codebase_id", "relative_path"]


def file_diff(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(codebase_id, relative_path, sha256, size, mtime_ns, status) of every file on either side.

    Status: unchanged (size and time equal, the hash is not looked at), unchanged_touched (hash equal), added, modified,
    removed, skipped (its hash could not be taken).
    """
    s, m = scan.alias("s"), manifest.alias("m")
    both = s.join(m, F.expr("s.codebase_id = m.codebase_id and s.relative_path = m.relative_path"), "full_outer")
    same_place = (F.col("s.size") == F.col("m.size")) & (F.col("s.mtime_ns") == F.col("m.mtime_ns")) & (F.col("m.mtime_ns") != 0)
    status = (
        F.when(F.col("s.relative_path").isNull(), "removed")
        .when(same_place, "unchanged")
        .when(F.col("s.sha256").isNull(), "skipped")
        .when(F.col("m.relative_path").isNull(), "added")
        .when(F.col("s.sha256") != F.col("m.sha256"), "modified")
        .otherwise("unchanged_touched")
    )
    kept = F.when(status == "unchanged", F.col("m.sha256")).otherwise(F.coalesce("s.sha256", "m.sha256"))
    return both.select(
        *[F.coalesce(f"s.{c}", f"m.{c}").alias(c) for c in FILE_KEY],
        kept.alias("sha256"),
        *[F.coalesce(f"s.{c}", f"m.{c}").alias(c) for c in ("size", "mtime_ns")],
        status.alias("status"),
    )


def suspects(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files whose content must be read: size or time differ, or they are new; nothing here reads content."""
    same = F.expr("s.codebase_id = m.codebase_id and s.relative_path = m.relative_path and s.size = m.size and s.mtime_ns = m.mtime_ns and m.mtime_ns <> 0")
    return scan.alias("s").join(manifest.alias("m"), same, "left_anti")


def diff_report(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n_files"))


def next_manifest(diff: DataFrame) -> DataFrame:
    """What the manifest holds after a sync that pushed all changes."""
    return diff.where(F.col("status").isin("added", "modified", "unchanged", "unchanged_touched")).select(*FILE_KEY, "sha256", "size", "mtime_ns")


def last_of_equals(chunks: DataFrame) -> DataFrame:
    """One row per (relative_path, chunk_hash) within a collection: the last by ordinal."""
    order = Window.partitionBy("collection", "relative_path", "chunk_hash").orderBy(F.desc("ordinal"))
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


CHUNK_KEY = ["collection", "relative_path", "chunk_hash"]


def chunk_diff(new: DataFrame, stored: DataFrame, pushed: DataFrame) -> DataFrame:
    """(collection, relative_path, chunk_hash, status): reused, inserted or deleted.

    pushed: (collection, relative_path) of the files that were split without an error; a file that gives no chunk loses all it had.
    """
    path = ["collection", "relative_path"]
    old = stored.select(*CHUNK_KEY).join(pushed.select(*path).distinct(), path, "left_semi").withColumn("_old", F.lit(True))
    own = new.select(*CHUNK_KEY).where("relative_path <> ''").distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").otherwise("reused")
    return own.join(old, CHUNK_KEY, "full_outer").select(*CHUNK_KEY, status.alias("status"))


def upsert_stats(diff: DataFrame, pushed: DataFrame) -> DataFrame:
    """One row of counts of an upsert."""
    n = lambda *s: F.count_if(F.col("status").isin(*s)).alias
    counts = diff.agg(n("inserted", "reused")("chunks_processed"), n("inserted")("chunks_new_embedded"), n("reused")("chunks_reused"), n("deleted")("chunks_deleted"))
    return pushed.agg(F.count("*").alias("files_processed")).join(counts)


def delete_files(stored: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, chunks that go) when the files of paths (collection, relative_path) are deleted."""
    key = ["collection", "relative_path"]
    ids = paths.select(*key).distinct()
    return stored.join(ids, key, "left_anti"), stored.join(ids, key, "left_semi")


def too_many_failed(failed: int, total: int) -> bool:
    return failed * 2 > total


def sum_results(results: DataFrame) -> DataFrame:
    """One row of sums of the counts of several upserts."""
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("files_processed", "chunks_processed", "chunks_new_embedded", "chunks_reused", "chunks_deleted")])


def first_failures(failures: DataFrame, n: int = 3) -> DataFrame:
    return failures.orderBy("batch").limit(n)
