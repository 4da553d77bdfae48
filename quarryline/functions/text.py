"""Column expressions over paths, contents and ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension, case-sensitive.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cs": "csharp", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".m": "objc", ".mm": "objc",
    ".lua": "lua", ".sh": "bash", ".bash": "bash", ".md": "markdown",
}
#: Extensions that a scan admits, lower-cased.
ADMITTED = tuple(e for e in LANGUAGES if e not in (".m", ".mm"))
#: Names and colours that a list shows.
DISPLAY = {
    "go": ("Go", "#00ADD8"), "typescript": ("TypeScript", "#3178c6"), "javascript": ("JavaScript", "#f1e05a"), "python": ("Python", "#3572A5"),
    "java": ("Java", "#b07219"), "rust": ("Rust", "#dea584"), "c": ("C", "#555555"), "cpp": ("C++", "#f34b7d"), "csharp": ("C#", "#178600"),
    "ruby": ("Ruby", "#701516"), "php": ("PHP", "#4F5D95"), "swift": ("Swift", "#F05138"), "kotlin": ("Kotlin", "#A97BFF"),
    "scala": ("Scala", "#c22d40"), "lua": ("Lua", "#000080"), "bash": ("Shell", "#89e051"), "markdown": ("Markdown", "#083fa1"),
}
OTHER_NAME, OTHER_COLOUR = "Other", "#8b949e"
EXTENSION = r"(\.[^./]*)$"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, EXTENSION, 1)


def language_of(path: Column) -> Column:
    """Language by suffix; unknown where none fits or the path is nothing but the suffix."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    named = F.element_at(F.create_map(*pairs), extension(path))
    return F.when(F.length(path) > F.length(extension(path)), F.coalesce(named, F.lit("unknown"))).otherwise("unknown")


def admitted(path: Column, size: Column, most: int = 1 << 20) -> Column:
    return F.lower(extension(path)).isin(*ADMITTED) & (size <= most)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """What stands before the last slash, with it; empty without one."""
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    # A run is only tried from its start, so inner ones are passed over in one step.
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def drop_reason(content: Column, min_bytes: int = 100) -> Column:
    """Why a chunk is not worth keeping: blank, short, imports, comments; null where it is."""
    body = trimmed(content)
    lines = F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: x != "")
    code = F.filter(lines, lambda x: ~(x.startswith("//") | x.startswith("#")))

    def imports(x: Column) -> Column:
        start = [x.startswith(p) for p in ("import ", "import(", "using ", "require ", "require(")]
        ended = (x.startswith("use ") | x.startswith("package ")) & x.endswith(";")
        out = (x.startswith("from ") & F.contains(x, F.lit(" import "))) | ended | x.isin("(", ")", "{", "}")
        for s in start:
            out = out | s
        return out

    def comment(x: Column) -> Column:
        return x.startswith("//") | x.startswith("#") | x.startswith("*") | x.startswith("/*") | x.startswith("<!--")

    out = F.when(body == "", "blank")
    if min_bytes > 0:
        out = out.when(F.octet_length(body) < min_bytes, "short")
    return out.when((F.size(code) > 0) & F.forall(code, imports), "imports").when((F.size(lines) > 0) & F.forall(lines, comment), "comments")


def chunk_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, content_hash: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", path, content_hash), 256), F.lit(32))


def collection_name(codebase_id: Column, prefix: str = "ql_") -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(codebase_id, 256), F.lit(24)))


def codebase_id(root: Column) -> Column:
    """Name of the folder and a short hash of its absolute path."""
    return F.concat_ws("-", base_name(root), F.left(F.sha2(root, 256), F.lit(8)))


def token_estimate(text: Column, extra: int = 0) -> Column:
    """Bytes by three, at least one; extra is added by providers that count so."""
    return F.greatest(F.floor(F.octet_length(text) / 3) + extra, F.lit(1)).cast("bigint")


def repair_bytes(raw: bytes, mark: str = "�") -> str:
    """UTF-8 with every run of invalid bytes replaced by one mark."""
    return re.sub("[\udc80-\udcff]+", mark, raw.decode("utf-8", "surrogateescape"))


def repair_utf8(raw: Column) -> Column:
    def repaired(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else repair_bytes(bytes(b)))

    return F.pandas_udf(repaired, "string")(raw)


def truncated(content: Column, most: int = 60000) -> Column:
    """The first bytes of a text, repaired where the cut splits a character; Python only runs where it is needed."""
    raw = F.substring(content.cast("binary"), 1, most)
    whole = F.octet_length(content) <= most
    plain = F.when(whole, content).when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.coalesce(plain, repair_utf8(F.when(~whole, raw)))


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) > 0


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
