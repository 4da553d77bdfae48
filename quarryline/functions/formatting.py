"""What results look like to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DISPLAY, OTHER_COLOUR, OTHER_NAME

HEADER = "The following code sections were retrieved:\n"
NOTHING = "No results found.\n"


def numbered_lines(content: Column, start_line: Column) -> Column:
    """Every line with its number in six places."""
    lines = F.transform(F.split(content, "\n"), lambda line, i: F.concat(F.lpad((start_line + i).cast("string"), 6, " "), F.lit("  "), line, F.lit("\n")))
    return F.array_join(lines, "")


def result_text(results: DataFrame) -> DataFrame:
    """One row (text) of results (rank, relative_path, start_line, content) in rank order."""
    block = F.concat(F.lit("Path: "), "relative_path", F.lit("\n"), numbered_lines(F.col("content"), F.col("start_line")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda r: r["block"]), "...\n\n")
    return results.agg(ordered.alias("_rows"), joined.alias("_text")).select(
        F.when(F.size("_rows") == 0, NOTHING).otherwise(F.concat(F.lit(HEADER), "_text")).alias("text")
    )


def preview(content: Column, most: int = 160) -> Column:
    """A text on one line, cut at `most` bytes; the bytes of a split character are dropped."""
    line = F.replace(content, F.lit("\n"), F.lit(" ⏎ "))
    raw = F.substring(line.cast("binary"), 1, most)
    whole = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", "")
    return F.when(F.octet_length(line) <= most, line).otherwise(F.concat(whole, F.lit("...")))


def score_tone(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def score_percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("bigint")


def pretty_id(codebase_id: Column) -> tuple[Column, Column]:
    """(name, hash) at the last dash, the whole id and nothing where no dash stands inside."""
    name, tail = (F.regexp_extract(codebase_id, r"^(.+)-([^-]+)$", i) for i in (1, 2))
    return F.when(name == "", codebase_id).otherwise(name), F.when(name == "", "").otherwise(tail)


def clamped(content: Column, shown: int = 20, most: int = 24) -> Column:
    """The first lines of a long text, all of a shorter one."""
    lines = F.split(content, "\n")
    return F.when(F.size(lines) > most, F.array_join(F.slice(lines, 1, shown), "\n")).otherwise(content)


def copy_all(results: DataFrame) -> DataFrame:
    """One row (text) of results (rank, relative_path, start_line, content): each under a comment with its place."""
    block = F.concat(F.lit("// "), "relative_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.agg(F.array_join(F.transform(ordered, lambda r: r["block"]), "\n\n").alias("text"))


def language_label(language: Column) -> tuple[Column, Column]:
    """(name, colour) that a list shows for a language."""
    key = F.lower(language)
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in DISPLAY.items() for x in (k, v[0])]), key)
    colour = F.element_at(F.create_map(*[F.lit(x) for k, v in DISPLAY.items() for x in (k, v[1])]), key)
    other = F.when(key.isin("other", ""), OTHER_NAME).otherwise(language)
    return F.coalesce(name, other), F.coalesce(colour, F.lit(OTHER_COLOUR))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1 << 20, F.format_string("%.2f MiB", F.bround(n / (1 << 20), 2)))
        .when(n >= 1 << 10, F.format_string("%.1f KiB", F.bround(n / (1 << 10), 1)))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def human_duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, from the largest that is not zero."""
    s = F.floor(seconds + 0.5).cast("bigint")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    minutes = F.floor(s / 60)
    return (
        F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))
        .when(s >= 60, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )
