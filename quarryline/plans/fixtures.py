"""The tables of a corpus in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCOPE = "corpus"
PREFIX = "ql_"
QUERY = "thereou ertion the onthe getOrder heation @RepeatSubmit ningly"
EXTENSIONS = (".go", ".py", ".md", ".tsx", ".PY", ".mm", ".txt", ".java")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("codebase_id"),
        "doc_id",
        F.concat(F.lit("dir"), (F.col("doc_id") % 5).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), ext).alias("relative_path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        (F.lit(1704067200000000000) + F.col("doc_id") * 1000000000).alias("mtime_ns"),
    )


def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier sync saw: some files missing, some changed, some touched, some since removed."""
    f = files(spark, sf_dir)
    old = f.where("doc_id % 10 <> 0")
    changed = F.col("doc_id") % 7 == 0
    kept = old.select(
        "codebase_id",
        "relative_path",
        F.when(changed, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(changed, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(~changed & (F.col("doc_id") % 3 == 0), F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
    )
    ghosts = f.where("doc_id % 10 = 1").select("codebase_id", F.concat(F.lit("gone/"), "relative_path").alias("relative_path"), "sha256", "size", "mtime_ns")
    return kept.unionByName(ghosts)


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a file, in one collection for all."""
    f = files(spark, sf_dir).withColumn("chunk_hash", F.col("sha256"))
    return f.select(
        T.collection_name(F.lit(SCOPE), PREFIX).alias("collection"),
        T.chunk_id(F.col("relative_path"), F.col("chunk_hash")).alias("id"),
        "chunk_hash",
        "content",
        "relative_path",
        F.lit(1).alias("start_line"),
        T.line_count(F.col("content")).cast("int").alias("end_line"),
        T.language_of(F.col("relative_path")).alias("language"),
        "doc_id",
        "codebase_id",
    )


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("chunk_hash"))
    rows = new_chunks(spark, sf_dir).where("doc_id % 10 <> 0").withColumn("chunk_hash", old)
    return rows.withColumn("id", T.chunk_id(F.col("relative_path"), F.col("chunk_hash")))


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks with the vector of the same number, where there is one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return new_chunks(spark, sf_dir).join(v, "doc_id", "left")


def one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QUERY with the vector of the smallest number."""
    v = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1)
    return v.select(F.lit(0).cast("bigint").alias("query_id"), T.collection_name(F.lit(SCOPE), PREFIX).alias("collection"), F.lit(QUERY).alias("query"), F.col("embedding").alias("query_vector"))


def many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text with the vector of its number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return b.join(v, "query_id").withColumn("collection", T.collection_name(F.lit(SCOPE), PREFIX))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("cb-"), (F.col("user_id") % 5).cast("string")).alias("codebase_id"),
        F.concat("event_type", F.lit(" "), (F.col("user_id") % 3).cast("string")).alias("query"),
        "ts",
    )


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the guise of code: imports alone, comments alone, short, both, and prose, by the number of the document."""
    line = F.concat(F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")), F.lit(" "), F.repeat(F.lit("z"), F.lit(40)))
    kind = F.col("doc_id") % 6
    content = (
        F.when(kind == 0, F.concat(F.lit("import "), line, F.lit("\n\nfrom a import "), line, F.lit("\nuse b::c;\n(\n")))
        .when(kind == 1, F.concat(F.lit("# "), line, F.lit("\n  // "), line, F.lit("\n/* a */\n* b\n")))
        .when(kind == 2, F.concat(F.lit("import x\n# "), F.left("source", F.lit(20))))
        .when(kind == 3, F.concat(F.lit("# "), line, F.lit("\nimport "), line))
        .when(kind == 4, F.concat(F.lit("package "), line, F.lit("\nimport "), line))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def camel(text: Column) -> Column:
    """A text with some words joined as in camel case."""
    for c in "taeds":
        text = F.replace(text, F.lit(f" {c}"), F.lit(c.upper()))
    return text


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections of two thirds of the codebases."""
    ids = files(spark, sf_dir).select("codebase_id").distinct().where("length(codebase_id) > 4")
    return ids.select(T.collection_name(F.col("codebase_id"), PREFIX).alias("collection"), "codebase_id")


def codebase_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New chunks in the collections of their codebases."""
    return new_chunks(spark, sf_dir).withColumn("collection", T.collection_name(F.col("codebase_id"), PREFIX))
