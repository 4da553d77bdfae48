"""What is shown about indexes: lists, languages, recent searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collection_name


def list_indexes(chunks: DataFrame, registry: DataFrame, prefix: str = "ql_") -> DataFrame:
    """(collection, codebase_id, num_chunks) of every collection with the prefix; unregistered ones have an empty id."""
    counts = chunks.where(F.col("collection").startswith(prefix)).groupBy("collection").agg(F.count("*").alias("num_chunks"))
    return counts.join(registry.select("collection", "codebase_id"), "collection", "left").select("collection", F.coalesce("codebase_id", F.lit("")).alias("codebase_id"), "num_chunks")


def language_histogram(chunks: DataFrame) -> DataFrame:
    """(collection, language, n_chunks); a missing language counts as other."""
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("other"))
    return chunks.groupBy("collection", language.alias("language")).agg(F.count("*").alias("n_chunks"))


def language_map(histogram: DataFrame) -> DataFrame:
    """(collection, languages) as a map."""
    return histogram.groupBy("collection").agg(F.map_from_entries(F.collect_list(F.struct("language", "n_chunks"))).alias("languages"))


def language_share(histogram: DataFrame, shown: int = 3) -> DataFrame:
    """(collection, language, n_chunks, percent, rank, n_more): the largest shares, and how many languages are not shown."""
    own = Window.partitionBy("collection")
    best = own.orderBy(F.desc("n_chunks"), "language")
    rows = histogram.withColumn("rank", F.row_number().over(best)).withColumn("total", F.sum("n_chunks").over(own)).withColumn("langs", F.count("*").over(own))
    percent = F.floor(F.col("n_chunks") * 100 / F.col("total") + 0.5).cast("bigint")
    more = F.greatest(F.col("langs") - shown, F.lit(0))
    return rows.where(F.col("rank") <= shown).select("collection", "language", "n_chunks", percent.alias("percent"), "rank", more.alias("n_more"))


def resolve_indexes(indexes: DataFrame, remembered: DataFrame, prefix: str = "ql_") -> DataFrame:
    """indexes with the ids that a user remembers for unnamed ones: (collection, id, named, num_chunks)."""
    known = remembered.select(F.col("codebase_id").alias("remembered_id"), collection_name(F.col("codebase_id"), prefix).alias("collection")).distinct()
    both = indexes.join(known, "collection", "left")
    named = F.coalesce(F.nullif(F.col("codebase_id"), F.lit("")), F.col("remembered_id"))
    return both.select("collection", F.coalesce(named, F.lit("")).alias("id"), named.isNotNull().alias("named"), "num_chunks")


def listed(resolved: DataFrame) -> DataFrame:
    """Named ones first, then by size; with their position."""
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("named"), F.desc("num_chunks"), "collection"))
    return resolved.withColumn("position", order)


def default_index(resolved: DataFrame) -> DataFrame:
    """The id of the largest named index."""
    return resolved.where("named").orderBy(F.desc("num_chunks"), "id").limit(1).select("id", "num_chunks")


def in_scope(resolved: DataFrame, typed: str) -> DataFrame:
    """The indexes whose id holds what was typed, in any case, the largest first; exact marks an equal id."""
    shown = resolved.where(F.contains(F.lower("id"), F.lit(typed.strip().lower())))
    return shown.withColumn("exact", F.col("id") == typed.strip()).orderBy(F.desc("num_chunks"), "id")


def recent_searches(log: DataFrame, shown: int = 8) -> DataFrame:
    """(codebase_id, query, ts): the last use of each search, newest first."""
    last = log.groupBy("codebase_id", "query").agg(F.max("ts").alias("ts"))
    return last.orderBy(F.desc("ts"), "codebase_id", "query").limit(shown)


def remembered_ids(log: DataFrame, forgotten: DataFrame | None = None) -> DataFrame:
    """(codebase_id, last_used) of all ids used and not forgotten."""
    last = log.groupBy("codebase_id").agg(F.max("ts").alias("last_used"))
    return last if forgotten is None else last.join(forgotten.select("codebase_id").distinct(), "codebase_id", "left_anti")


def rank_label(*order: Column) -> Column:
    return F.row_number().over(Window.orderBy(*order))
