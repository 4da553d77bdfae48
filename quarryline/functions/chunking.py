"""Cutting sources into chunks: whole small files, structural blocks, lines with overlap.

Sizes are bytes of UTF-8. A chunk is (content, start_line, end_line), lines from 1.
"""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import text as T

Chunk = tuple[bytes, int, int]
#: (kind, first byte, last byte, children): kind is "definition", "comment" or "other".
Node = tuple[str, int, int, list]


def _blank(raw: bytes) -> bool:
    return not T.repair_bytes(raw).strip().strip("\x85")


def split_lines(raw: bytes, most: int, overlap: int = 0, base: int = 1) -> list[Chunk]:
    """Greedy packing of lines into at most `most` bytes; the next chunk starts `overlap` bytes of whole lines back.

    A longer line that starts a chunk is cut every `most` bytes. Empty lines at the start of a chunk count its first
    line but are not in its content. Chunks that are blank are left out.
    """
    if _blank(raw):
        return []
    lines = raw.split(b"\n")
    out: list[Chunk] = []
    at = 0
    while at < len(lines):
        start, held, size = at, [], 0
        while at < len(lines):
            line = lines[at]
            if not size and len(line) > most:
                out += [(line[k : k + most], base + at, base + at) for k in range(0, len(line), most)]
                at += 1
                start, held = at, []
                continue
            grown = size + len(line) + (1 if size else 0)
            if grown > most:
                break
            if size or line:
                held.append(line)
            size, at = grown, at + 1
        body = b"\n".join(held)
        if not _blank(body):
            out.append((body, base + start, base + at - 1))
        if overlap > 0 and start < at < len(lines):
            at = _back(lines, start, at, overlap)
    return out


def _back(lines: list[bytes], start: int, at: int, overlap: int) -> int:
    """The line to go on from: after the last line before `at` with `overlap` bytes from it on, never the start itself."""
    costs = accumulate(len(lines[j]) + 1 for j in range(at - 1, start, -1))
    covered = next((n for n, cost in enumerate(costs, 1) if cost >= overlap), at - 1 - start)
    return at - covered


def merge_small(chunks: list[Chunk], most: int) -> list[Chunk]:
    """Joins a chunk under a quarter of `most` with the next where their sizes add up to at most `most`."""
    out: list[Chunk] = []
    for body, first, last in chunks:
        if out and len(out[-1][0]) < most // 4 and len(out[-1][0]) + len(body) <= most:
            out[-1] = (out[-1][0] + b"\n" + body, out[-1][1], last)
        else:
            out.append((body, first, last))
    return out


def split_node(raw: bytes, node: Node, most: int, overlap: int) -> list[Chunk]:
    """Packs the direct children of a large node, each followed by a line end; larger children are cut by lines."""
    out: list[Chunk] = []
    held, first, last = b"", 0, 0
    line_of = lambda at: raw.count(b"\n", 0, at) + 1
    for _, a, b, _ in node[3]:
        body = raw[a:b]
        if held and len(held) + len(body) + 1 > most:
            out, held = [*out, (held, first, last)], b""
        if len(body) > most:
            out += split_lines(body, most, overlap, line_of(a))
            continue
        first = first if held else line_of(a)
        held, last = held + body + b"\n", line_of(b)
    if held.strip():
        out.append((held, first, last))
    return out


def split_nodes(raw: bytes, nodes: list[Node], most: int, overlap: int) -> list[Chunk]:
    """Chunks of the top-level nodes: definitions and other code, comments left out, small neighbours merged."""
    out: list[Chunk] = []
    for node in nodes:
        kind, a, b, children = node
        body = raw[a:b]
        if kind == "comment" or _blank(body):
            continue
        first, last = raw.count(b"\n", 0, a) + 1, raw.count(b"\n", 0, b) + 1
        if len(body) <= most:
            out.append((body, first, last))
        elif kind == "definition" and children:
            out += split_node(raw, node, most, overlap)
        else:
            out += split_lines(body, most, overlap, first)
    return merge_small(out, most)


def python_nodes(raw: bytes) -> list[Node] | None:
    """Top-level nodes of a Python source by its syntax tree; None where it does not parse."""
    try:
        tree = ast.parse(raw)
    # The parser's stack overflows with a MemoryError.
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    # The parser counts a carriage return alone as a line end too.
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]

    def first_of(x: ast.stmt) -> int:
        top = min([x, *getattr(x, "decorator_list", [])], key=lambda y: y.lineno)
        # The sign of a decorator stands before its expression.
        return starts[top.lineno - 1] + top.col_offset if top is x else raw.rfind(b"@", starts[top.lineno - 1], starts[top.lineno - 1] + top.col_offset)

    def node(x: ast.stmt) -> Node:
        first, last = first_of(x), starts[x.end_lineno - 1] + x.end_col_offset
        if not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return "other", first, last, []
        # What stands before the body is the first child; comments go with the statement before them.
        spots = [first, *(first_of(c) for c in x.body), last]
        return "definition", first, last, [("other", a, a + len(raw[a:b].rstrip()), []) for a, b in zip(spots, spots[1:], strict=False) if raw[a:b].strip()]

    return [node(x) for x in tree.body]


#: Languages whose blocks are told by braces.
BRACED = ("go", "javascript", "typescript", "java", "c", "cpp", "csharp", "rust", "php", "swift", "kotlin", "scala")
_TOKEN = re.compile(rb"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{}]|\n\s*\n", re.S)


def braced_nodes(raw: bytes) -> list[Node] | None:
    """Top-level stretches of a brace language, cut after a closing brace at depth 0 and at empty lines there."""
    depth, start, out = 0, 0, []
    inner: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(raw):
        token = m.group()
        if token == b"{":
            depth += 1
            if depth == 1:
                inner.append((m.end(), m.end()))
        elif token == b"}":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0 and inner:
                inner[-1] = (inner[-1][0], m.start())
                end = m.end() + (1 if raw[m.end() : m.end() + 1] in (b";", b")") else 0)
                out.append(_stretch(raw, start, end, inner))
                start, inner = end, []
        elif depth == 0 and not token.strip():
            out.append(_stretch(raw, start, m.start(), []))
            start = m.end()
    if depth:
        return None
    out.append(_stretch(raw, start, len(raw), []))
    return [n for n in out if n[1] < n[2]]


def _stretch(raw: bytes, a: int, b: int, inner: list[tuple[int, int]]) -> Node:
    while a < b and raw[a : a + 1].isspace():
        a += 1
    body = raw[a:b]
    lines = [x.strip() for x in body.split(b"\n") if x.strip()]
    comment = bool(lines) and all(x.startswith((b"//", b"/*", b"*")) for x in lines)
    children: list[Node] = []
    if inner:
        spots = [a]
        for first, last in inner:
            spots += [first, *(first + m.end() for m in re.finditer(rb"\n", raw[first:last])), last]
        spots.append(b)
        children = [("other", p, q, []) for p, q in zip(spots, spots[1:], strict=False) if raw[p:q].strip()]
    return ("comment" if comment else "definition" if inner else "other", a, b, children)


Boundaries = Callable[[bytes], list[Node] | None]
#: By language: what a comment starts with, and what starts a line that goes on with the block above it.
INDENTED = {
    "ruby": (b"#", rb"(?:end|else|elsif|rescue|ensure|when|in|then)\b|[)\]}]"),
    "lua": (b"--", rb"(?:end|else|elseif|until)\b|[)\]}]"),
    "bash": (b"#", rb"(?:fi|done|esac|else|elif|then|do)\b|[)\]{}]"),
}


def indented_nodes(raw: bytes, comment: bytes, goes_on: re.Pattern) -> list[Node]:
    """Top-level stretches of a language with closing words: a line at the margin starts one, unless it goes on with the one above.

    Children are the header and the stretches that start at the smallest indentation inside. Every line is in some node.
    """
    lines = raw.split(b"\n")
    starts = [0, *accumulate(len(line) + 1 for line in lines)]
    held = [k for k, line in enumerate(lines) if line.strip()]
    deep = {k: len(lines[k]) - len(lines[k].lstrip()) for k in held}

    def heads(of: list[int], margin: int) -> list[list[int]]:
        out: list[list[int]] = []
        for k in of:
            if out and (deep[k] > margin or goes_on.match(lines[k].lstrip())):
                out[-1].append(k)
            else:
                out.append([k])
        return out

    def spot(of: list[int]) -> tuple[int, int]:
        return starts[of[0]], starts[of[-1]] + len(lines[of[-1]].rstrip())

    out: list[Node] = []
    for own in heads(held, 0):
        if all(lines[k].lstrip().startswith(comment) for k in own):
            out.append(("comment", *spot(own), []))
        elif len(own) == 1:
            out.append(("other", *spot(own), []))
        else:
            inner = heads(own[1:], min((deep[k] for k in own[1:] if deep[k]), default=0))
            out.append(("definition", *spot(own), [("other", *spot(part), []) for part in (own[:1], *inner)]))
    return out


#: What finds the top-level nodes of a language; others are cut by lines.
PROVIDERS: dict[str, Boundaries] = {"python": python_nodes} | {name: braced_nodes for name in BRACED}
PROVIDERS |= {name: functools.partial(indented_nodes, comment=mark, goes_on=re.compile(more)) for name, (mark, more) in INDENTED.items()}


def split_source(raw: bytes, path: str, config: EngineConfig = EngineConfig(), language: str | None = None) -> list[Chunk]:
    """Chunks of a source: whole where small, else by structure, else by lines."""
    if _blank(raw):
        return []
    if len(raw) <= config.whole_file_bytes:
        return [(raw, 1, raw.count(b"\n") + 1)]
    language = language or detect(path)
    nodes = PROVIDERS[language](raw) if language in PROVIDERS else None
    found = split_nodes(raw, nodes, config.max_chunk_bytes, config.overlap_bytes) if nodes else []
    return found or split_lines(raw, config.max_chunk_bytes, config.overlap_bytes)


def detect(path: str) -> str:
    at = path.rfind(".")
    end = path[at:] if at > 0 else ""
    return T.LANGUAGES.get(end, "unknown")


def chunk_files(files: DataFrame, config: EngineConfig = EngineConfig(), content: str = "content") -> DataFrame:
    """(..., ordinal, content, start_line, end_line, language) of files (relative_path, content, ...).

    Small files are one projection and never leave the JVM; only larger ones are split in Python, in Arrow batches.
    """
    keys = [c for c in files.columns if c != content]
    lang = T.language_of(F.col("relative_path"))
    whole = files.where((F.octet_length(content) <= config.whole_file_bytes) & (T.trimmed(F.col(content)) != "")).select(
        *keys, F.lit(0).alias("ordinal"), F.col(content).alias("content"), F.lit(1).alias("start_line"), T.line_count(F.col(content)).cast("int").alias("end_line"), lang.alias("language")
    )
    large = files.where(F.octet_length(content) > config.whole_file_bytes).select(*keys, F.col(content).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                raw = row.content.encode()
                for k, (body, first, last) in enumerate(split_source(raw, row.relative_path, config)):
                    rows.append((*[getattr(row, c) for c in keys], k, T.repair_bytes(body), first, last, detect(row.relative_path)))
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", "content", "start_line", "end_line", "language"])

    types = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", ordinal int, content string, start_line int, end_line int, language string"
    return whole.unionByName(large.mapInPandas(run, schema))


def chunk_lines(files: DataFrame, most: int, overlap: int) -> DataFrame:
    """(..., ordinal, content, start_line, end_line) of files (..., content), cut by lines alone."""
    keys = [c for c in files.columns if c != "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                # Without content there is no chunk.
                for k, (body, first, last) in enumerate(split_lines((row.content or "").encode(), most, overlap)):
                    rows.append((*[getattr(row, c) for c in keys], k, T.repair_bytes(body), first, last))
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", "content", "start_line", "end_line"])

    types = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", ordinal int, content string, start_line int, end_line int"
    return files.select(*keys, "content").mapInPandas(run, schema)
