"""A source tree as a table: spark.read.format("source_tree").load(root) after spark.dataSource.register(SourceTree).

Unlike the built-in binary reader it sees files whose names start with a dot or an underscore; folders that start
with a dot are pruned, as are ignored ones, before they are listed. Every folder below the root is a partition.
Options: patterns (JSON list, besides the defaults), maxBytes, extensions (JSON list), content (true or false), ignoreFiles (JSON list of
names of ignore files in the root).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import ADMITTED
from ..model import SCAN
from .ignore import DEFAULTS, compile_all, read_patterns


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        patterns = [*DEFAULTS, *json.loads(options.get("patterns", "[]"))]
        for name in json.loads(options.get("ignorefiles", '[".gitignore", ".quarrylineignore"]')):
            try:
                with open(os.path.join(self.root, name), encoding="utf-8", errors="replace") as file:
                    patterns += read_patterns(file)
            except OSError:
                pass
        self.ignored = [re.compile(p, re.S) for p in compile_all(patterns)]
        self.most = int(options.get("maxbytes", 1 << 20))
        self.extensions = tuple(json.loads(options["extensions"])) if "extensions" in options else ADMITTED
        self.with_content = options.get("content", "true").lower() == "true"

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _skipped(self, path: str) -> bool:
        relative = self._relative(path)
        return any(p.search(relative) for p in self.ignored)

    def _folders(self, path: str) -> list[str]:
        try:
            entries = [e for e in os.scandir(path) if e.is_dir(follow_symlinks=False)]
        except OSError:
            return []
        return sorted(e.path for e in entries if not e.name.startswith(".") and not self._skipped(e.path))

    def partitions(self) -> list[Folder]:
        return [Folder(self.root, False), *(Folder(p, True) for p in self._folders(self.root))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            here = todo.pop()
            if partition.deep:
                todo += self._folders(here)
            try:
                files = sorted((e for e in os.scandir(here) if e.is_file(follow_symlinks=False)), key=lambda e: e.name)
            except OSError:
                continue
            for entry in files:
                if not os.path.splitext("x" + entry.name)[1].lower().endswith(self.extensions) or self._skipped(entry.path):
                    continue
                try:
                    state = entry.stat()
                    if state.st_size > self.most:
                        continue
                    content = None
                    if self.with_content:
                        with open(entry.path, "rb") as file:
                            content = file.read()
                except OSError:
                    continue
                yield entry.path, self._relative(entry.path), state.st_size, state.st_mtime_ns, content


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, list | tuple | bool) else str(v))
    return reader.load(root)


def find_root(start: str, tool_dir: str = ".quarryline") -> str:
    """The nearest folder from start up that holds the tool's folder or a repository; start where none does."""
    here = os.path.abspath(start)
    while True:
        if any(os.path.isdir(os.path.join(here, d)) for d in (tool_dir, ".git")):
            return here
        if (up := os.path.dirname(here)) == here:
            return os.path.abspath(start)
        here = up
