"""Identifier tokens of a text: whole identifiers, their parts, and their frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTIFIER = r"(@?[A-Za-z][A-Za-z0-9_]{2,})"
CAMEL = r"(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][^A-Z])"
# Words that are no signal, as general English, programming keywords and frequent names.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "have", "has", "are", "was", "were", "but", "not", "you", "can", "will", "would", "could", "should",
    "public", "private", "protected", "static", "final", "void", "return", "true", "false", "null", "import", "package", "class", "interface", "extends",
    "implements", "func", "const", "var", "let", "function", "if", "else", "for_", "while", "switch", "case", "default", "break", "continue", "new", "throw",
    "throws", "try", "catch", "finally", "string", "int", "boolean", "long", "short", "double", "float", "map", "list", "set", "array",
    "get", "set_", "put", "is_",
)


def _kept(x: Column) -> Column:
    return (F.length(x) >= 3) & ~F.regexp_replace(x, "^@", "").isin(*STOP_WORDS)


def tokens(content: Column) -> Column:
    """Array of the tokens of a text, each as often as it occurs.

    An identifier gives its lower-case form and, unless that is a stop word, those of its camel-case parts
    that differ from it and are no stop words.
    """

    def of(found: Column) -> Column:
        raw = F.lower(found)
        body = F.regexp_replace(raw, "^@", "")
        parts = F.transform(F.split(F.regexp_replace(found, "^@", ""), CAMEL), lambda p: F.lower(p))
        subs = F.filter(parts, lambda p: (p != body) & (p != raw) & _kept(p))
        return F.when(_kept(raw), F.concat(F.array(raw), subs)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.regexp_extract_all(content, F.lit(IDENTIFIER), F.lit(1)), of))


def token_rows(chunks: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of chunks with token, a row for each occurrence: the same tokens as tokens().

    Identifiers become rows before they are looked at, so all but the camel-case ones stay in compiled code.
    """
    keys = [c for c in chunks.columns if c != content]
    found = chunks.select(*keys, F.explode(F.regexp_extract_all(content, F.lit(IDENTIFIER), F.lit(1))).alias("_found"))
    raw = found.select(*keys, "_found", F.lower("_found").alias("_raw")).where(_kept(F.col("_raw")))
    body = F.regexp_replace("_raw", "^@", "")
    parts = F.transform(F.split(F.regexp_replace("_found", "^@", ""), CAMEL), lambda p: F.lower(p))
    subs = F.filter(parts, lambda p: (p != body) & (p != F.col("_raw")) & _kept(p))
    several = F.col("_found").rlike("[A-Z]") | F.col("_found").startswith("@")
    all_ = F.when(several, F.concat(F.array("_raw"), subs)).otherwise(F.array("_raw"))
    return raw.select(*keys, F.explode(all_).alias("token"))


def postings(chunks: DataFrame, content: str = "content") -> DataFrame:
    """(..., token, tf) of chunks: all other columns of chunks, with the frequency of every token."""
    keys = [c for c in chunks.columns if c != content]
    return token_rows(chunks, content).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
