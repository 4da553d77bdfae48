"""Ignore patterns of a tree scan, compiled to regular expressions over relative paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that always hold.
DEFAULTS = (
    "node_modules", "vendor", "dist", "build", "out", "target", "coverage", ".git", ".svn", ".hg", ".idea", ".vscode",
    "__pycache__", ".pytest_cache", ".nyc_output", "logs", "tmp", "temp", ".cache",
    "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "yarn.lock",
)


def read_patterns(lines: Iterable[str]) -> list[str]:
    """Patterns of an ignore file: neither blank lines nor comments; `!` is an ordinary character."""
    stripped = (line.strip() for line in lines)
    return [line for line in stripped if line and not line.startswith("#")]


def _segment(glob: str) -> str | None:
    """A path segment's glob as a regular expression; None where it is malformed."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negated = body.startswith("^")
            body = body.removeprefix("^").replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^/' if negated else ''}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_pattern(pattern: str) -> str | None:
    """The regular expression of the paths that a pattern ignores; None where it can match nothing.

    A leading slash anchors to the root, otherwise any starting segment will do. A pattern that matches
    a folder matches all below it; `**` spans any number of segments.
    """
    p = pattern.strip()
    anchored = p.startswith("/")
    p = p.removeprefix("/").removesuffix("/**").removesuffix("/")
    if not p:
        return None
    parts = p.split("/")
    body = ""
    for k, part in enumerate(parts):
        final = k == len(parts) - 1
        if part == "**":
            body += ".*" if len(parts) == 1 else "(?:/.*)?" if final else "(?:[^/]+/)*"
            continue
        one = _segment(part)
        if one is None:
            return None
        following_all = k == len(parts) - 2 and parts[-1] == "**"
        body += one if final or following_all else one + "/"
    return ("^" if anchored else "^(?:.*/)?") + body + "(?:/.*)?$"


def compile_all(patterns: Iterable[str]) -> list[str]:
    return [r for r in (compile_pattern(p) for p in patterns) if r is not None]


def path_ignored(path: Column, patterns: Iterable[str]) -> Column:
    found = compile_all(patterns)
    return path.rlike("|".join(f"(?:{r})" for r in found)) if found else F.lit(False)
