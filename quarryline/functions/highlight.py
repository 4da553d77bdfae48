"""Tokens of source text by class: comment, string, number, keyword, plain; line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Words that are keywords in one language or another, and names of languages by the comments they use.
KEYWORDS = frozenset(
    """func function fn def lambda class struct interface enum trait impl type module mod namespace package import export
    from use using include require const let var val static final public private protected internal abstract virtual override
    extends implements pub mut ref out async await yield defer go
    if else elif for while do switch case match when default break continue return goto try catch except finally throw
    throws raise with as in of is and or not then end begin pass where select loop
    int uint long short byte char float double bool boolean string str void any unknown never object map list vec
    true false null nil none undefined this self super new delete typeof instanceof sizeof""".split()
)
HASH_LANGUAGES = (
    "python", "py", "ruby", "rb", "shell", "bash", "sh", "zsh", "fish", "yaml", "yml",
    "toml", "ini", "perl", "makefile", "dockerfile", "conf", "nginx", "graphql", "elixir",
)
SLASHES, HASH, DASHES, SQL = "slashes", "hash", "dashes", "sql"


def family(language: str | None) -> str:
    name = (language or "").lower()
    if "sql" in name:
        return SQL
    if any(h in name for h in HASH_LANGUAGES):
        return HASH
    return DASHES if "lua" in name else SLASHES


@lru_cache
def lexer(kind: str) -> re.Pattern:
    """One pattern whose named groups are the classes; an unclosed block comment or raw string runs to the end."""
    block = {SLASHES: r"/\*(?:.*?\*/|.*)", SQL: r"/\*(?:.*?\*/|.*)", DASHES: r"--\[\[(?:.*?\]\]|.*)"}.get(kind)
    line = {SLASHES: "//", HASH: "#"}.get(kind, "--") + r"[^\n]*"
    quotes = {SLASHES: "\"'", HASH: "\"'", DASHES: "\"'", SQL: "'"}[kind]
    strings = [rf"{q}(?:\\.|[^{q}\\\n])*(?:{q}|\\$|(?=\n)|$)" for q in quotes] + ([r"`(?:\\.|[^`\\])*(?:`|\\$|$)"] if kind == SLASHES else [])
    comment = "|".join(p for p in (block, line) if p)
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{'|'.join(strings)})|(?P<number>[0-9][0-9a-fA-FxXoObB._]*)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)", re.S)


def tokens(code: str, language: str | None) -> Iterator[tuple[str, str]]:
    """(text, class) in order; neighbouring plain text is one token."""
    plain, at = "", 0
    for m in lexer(family(language)).finditer(code):
        plain, at = plain + code[at : m.start()], m.end()
        kind = m.lastgroup
        if kind == "word":
            if m.group() not in KEYWORDS:
                plain += m.group()
                continue
            kind = "keyword"
        if plain:
            yield plain, "plain"
        plain = ""
        yield m.group(), kind
    if plain + code[at:]:
        yield plain + code[at:], "plain"


def highlight(code: str | None, language: str | None) -> Iterator[tuple[int, int, str, str]]:
    """(line from 1, place in the line from 0, text, class)."""
    line, place = 1, 0
    for text, kind in tokens(code or "", language):
        for k, part in enumerate(text.split("\n")):
            if k:
                line, place = line + 1, 0
            if part:
                yield line, place, part, kind
                place += 1


class Highlight:
    def eval(self, code: str, language: str):
        yield from highlight(code, language)


def register(spark: SparkSession) -> None:
    """Makes highlight(code, language) a table function of SQL, for use with LATERAL."""
    spark.udtf.register("highlight", udtf(Highlight, returnType="line int, place int, text string, class string"))
