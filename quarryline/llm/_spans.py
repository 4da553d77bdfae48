"""Positions of regular expression matches with built-in functions only.

regexp_extract_all gives the matches and split the text between them; their
lengths add up to code point offsets. Matches are summed in blocks of BLOCK, so a
text with very many matches costs BLOCK appends a match, not one per pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,text:string,before:string,after:string>>"
#: Code points of context kept on each side of a match, up to the next match of the kind.
CONTEXT = 40


def stage(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once even where then uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """struct(m: matches, g: the texts between them), null where guard is false or nothing matches."""
    found = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(
        found,
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")),
    )


def spans(found: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """The spans of one kind from the struct of matches(); keep sees the matched text."""
    m, g = found["m"], found["g"]
    parts = F.zip_with(
        m,
        F.sequence(F.lit(1), F.size(m)),
        lambda x, i: F.struct(x.alias("text"), F.element_at(g, i).alias("gap"), F.element_at(g, i + 1).alias("next")),
    )
    blocks = stage(
        parts,
        lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK)),
    )
    return F.when(found.isNull(), F.array().cast(SPAN)).otherwise(stage(blocks, lambda own: _placed(own, kind, rank, keep)))


def _width(p: Column) -> Column:
    return (F.length(p["gap"]) + F.length(p["text"])).cast("bigint")


def _placed(blocks: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None) -> Column:
    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + _width(p)).alias("end"),
            p["text"].alias("text"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.left(p["next"], F.lit(CONTEXT)).alias("after"),
        )
        kept = F.array(span).cast(SPAN)
        if keep is not None:
            kept = F.when(keep(p["text"]), kept).otherwise(F.array().cast(SPAN))
        return F.struct((acc["at"] + _width(p)).alias("at"), F.concat(acc["out"], kept).alias("out"))

    def one(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), add, lambda acc: acc["out"])

    starts = F.aggregate(
        blocks,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0).cast("bigint"), lambda s, p: s + _width(p)))),
    )
    return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), one))


def digest(all_spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("bigint")
