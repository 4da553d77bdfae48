"""A training corpus from `documents`: each stage works on what the one before it kept.

Defined cases: a null or empty text has no language and goes at the first stage; rows that repeat a document, or are near copies of it, give one row,
that of the smallest doc_id, and rows without a doc_id are texts like others; null sources are a source of their own; very
long texts are taken whole; further columns, whatever their names, stay up to the last stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import jaccard, language, mixing, packing, secrets
from quarryline.llm._shared import fresh, materialize, table

#: A text whose likeliest language has a smaller posterior is rejected, as is one without letters.
CONFIDENT = 0.5
#: Near copies share at least so many per cent of their shingles of so many words.
WORDS, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised."""
    name, score = fresh(docs.columns, "_lang_pred"), fresh(docs.columns, "_lang_score")
    found = language.identify(docs, language.fit(docs), out=(name, score))
    return found.where((F.col(name) != language.UND) & (F.col(score) >= CONFIDENT)).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.keep_first(docs, WORDS, PERCENT)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced."""
    clean = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("bigint"))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives the words that the mix takes of each document, in their order, repeats after them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("jaccard", jaccard_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The language model, the tokenizer and the block permutations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
