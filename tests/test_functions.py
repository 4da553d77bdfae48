"""Golden cases of the column functions, the tokenizer and the chunkers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline import cli
from quarryline.config import EngineConfig, first_set
from quarryline.functions import chunking, formatting, text, tokens
from quarryline.sources import ignore

TOKENS = {
    "createOrder": {"createorder": 1, "create": 1, "order": 1},
    "@RepeatSubmit": {"@repeatsubmit": 1, "repeat": 1, "submit": 1},
    "HTTPServer": {"httpserver": 1, "http": 1, "server": 1},
    "userID": {"userid": 1, "user": 1},
    "fooFoo": {"foofoo": 1, "foo": 2},
    "orderOrder order": {"orderorder": 1, "order": 3},
    "getOrder": {"getorder": 1, "order": 1},
    "user_id": {"user_id": 1},
    "public": {},
    "@Override": {"@override": 1},
    "9abc": {"abc": 1},
    "@@abc": {"@abc": 1},
    "@ab": {},
}


def test_tokens(spark):
    rows = spark.createDataFrame([(k,) for k in TOKENS], "c string").select("c", tokens.tokens(F.col("c")).alias("t")).collect()
    for r in rows:
        assert {t: r.t.count(t) for t in set(r.t)} == TOKENS[r.c], r.c


DROPS = [
    (" \t\n", 0, "blank"), ("x = 1", 100, "short"), ("import os\nfrom a import b", 0, "imports"), ("# c\nimport os", 0, "imports"), ("use a::b;", 0, "imports"),
    ("#include <a.h>", 0, "comments"), ("# a\n// b", 0, "comments"), ("// a\n/* b */\n* c", 0, "comments"), ('import (\n"fmt"\n)', 0, None), ("package main", 0, None),
]


@pytest.mark.parametrize(("content", "least", "reason"), DROPS)
def test_drop_reason(spark, content, least, reason):
    assert spark.createDataFrame([(content,)], "c string").select(text.drop_reason(F.col("c"), least)).first()[0] == reason


def _lines(content, most, overlap):
    return [(a, b, raw.decode()) for raw, a, b in chunking.split_lines(content.encode(), most, overlap)]


def test_split_lines_golden():
    four = "aaaa\nbbbb\ncccc\ndddd"
    assert _lines(four, 10, 4) == [(1, 2, "aaaa\nbbbb"), (2, 3, "bbbb\ncccc"), (3, 4, "cccc\ndddd")]
    assert [x[:2] for x in _lines(four, 10, 0)] == [(1, 2), (3, 4)]
    assert _lines("abcdefghij\nxy", 4, 0) == [(1, 1, "abcd"), (1, 1, "efgh"), (1, 1, "ij"), (2, 2, "xy")]
    assert _lines("\n\nab", 10, 0) == [(1, 3, "ab")]
    assert _lines(" \n\t", 10, 0) == []


def test_split_lines_properties():
    rng = random.Random(5)
    for _ in range(300):
        content = "\n".join("x" * rng.choice([0, 1, 3, 9, 30]) for _ in range(rng.randint(1, 30)))
        most, overlap = rng.randint(4, 40), rng.choice([0, 3, 10])
        found = _lines(content, most, overlap)
        covered = {k for a, b, _ in found for k in range(a, b + 1)}
        assert all(len(body) <= most for _, _, body in found)
        assert all(k in covered for k, line in enumerate(content.split("\n"), 1) if line)
        assert all(p[0] <= q[0] for p, q in zip(found, found[1:], strict=False))


def test_merge_and_structure():
    assert chunking.merge_small([(b"a", 1, 1), (b"bb", 2, 2), (b"ccccccc", 3, 3)], 8) == [(b"a\nbb", 1, 2), (b"ccccccc", 3, 3)]
    config = EngineConfig(max_chunk_bytes=400)
    source = "import os\n\n# note\n" + "".join(f"def f{i}(x):\n    return x + {i}\n\n" for i in range(300))
    found = chunking.split_source(source.encode(), "a.py", config)
    assert len(found) > 10
    assert all(len(raw) <= 401 for raw, _, _ in found)
    assert not any(b"# note" in raw for raw, _, _ in found)
    braces = "".join(f'function f{i}() {{ return "}}"; }}\n\n' for i in range(300))
    assert all(raw.startswith(b"function") for raw, _, _ in chunking.split_source(braces.encode(), "a.js", config))
    large = "class A:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(300))
    assert all(len(raw) <= 401 for raw, _, _ in chunking.split_source(large.encode(), "a.py", config))


def test_large_definitions_keep_every_line():
    """Headers, decorators and comments of large Python definitions are in their chunks."""
    rng, config = random.Random(12), EngineConfig(max_chunk_bytes=300, overlap_bytes=0)
    for _ in range(40):
        out = []
        for c in range(3):
            out += ["@registered(name='x',", f"            kind={c})"] if rng.random() < 0.5 else []
            out.append(f"class Big{c}(Base):" if rng.random() < 0.5 else f"async def giant_{c}(x, y={{1: 2}}):")
            out += ['    """Says what it is."""'] if rng.random() < 0.5 else []
            for m in range(rng.randint(3, 15)):
                out += [f"    # note {c} {m}"] if rng.random() < 0.4 else []
                out += ["    @staticmethod"] if rng.random() < 0.3 else []
                out += [f"    def m{m}(self):", f"        return '{'é' * rng.randrange(60)}{m}'", ""]
        source = "\n".join(out)
        whole = b"\n".join(raw for raw, _, _ in chunking.split_source(source.encode(), "a.py", EngineConfig(max_chunk_bytes=300, overlap_bytes=0, whole_file_bytes=10)))
        held = whole.decode()
        assert all(line.strip() in held for line in out if line.strip()), source
    assert config.max_chunk_bytes == 300


CLOSED = {
    "a.rb": "# note\nrequire 'set'\n\nclass Shop\n  # inside\n  def sell(x)\n    if x\n      1\n    else\n      2\n    end\n  end\n\n  def buy\n    3\n  end\nend\nx = <<~T\n  one\nT\n",
    "a.lua": "-- note\nlocal a = 1\nfunction f(x)\n  repeat\n    x = x - 1\n  until x < 0\n  return x\nend\nrepeat\n  f(1)\nuntil true\n",
    "a.sh": "#!/bin/sh\nset -e\nrun()\n{\n  if true; then\n    echo a\n  fi\n}\nfor x in 1 2\ndo\n  run $x\ndone\n",
}


@pytest.mark.parametrize("path", CLOSED)
def test_languages_with_closing_words(path):
    raw = CLOSED[path].encode()
    nodes = chunking.PROVIDERS[chunking.detect(path)](raw)
    kinds = [(kind, raw[a:b].split(b"\n")[0].decode(), raw[a:b].split(b"\n")[-1].decode()) for kind, a, b, _ in nodes]
    assert kinds == {
        "a.rb": [("comment", "# note", "# note"), ("other", "require 'set'", "require 'set'"), ("definition", "class Shop", "end"), ("definition", "x = <<~T", "  one"), ("other", "T", "T")],
        "a.lua": [("comment", "-- note", "-- note"), ("other", "local a = 1", "local a = 1"), ("definition", "function f(x)", "end"), ("definition", "repeat", "until true")],
        "a.sh": [("comment", "#!/bin/sh", "#!/bin/sh"), ("other", "set -e", "set -e"), ("definition", "run()", "}"), ("definition", "for x in 1 2", "done")],
    }[path]
    for most in (20, 40, 200):
        found = chunking.split_source(raw * 40, path, EngineConfig(max_chunk_bytes=most, overlap_bytes=0, whole_file_bytes=10))
        held = "\n".join(body.decode() for body, _, _ in found)
        assert all(line.strip() in held for line in CLOSED[path].split("\n")[1:] if line.strip())


def test_progress_line():
    assert cli.progress_line(1, 4, 30.0, 8) == "[==      ]  25% 1/4 1m30s left"
    assert cli.progress_line(0, 4, 1.0, 4) == "[    ]   0% 0/4" and cli.progress_line(0, 0, 1.0, 4) == "[====] 100% 0/0 0m00s left"


def test_null_content_has_no_chunk(spark):
    rows = spark.createDataFrame([("a.py", None), ("b.py", "x = 1")], "relative_path string, content string")
    assert [r.relative_path for r in chunking.chunk_lines(rows, 10, 0).collect()] == ["b.py"]
    assert [r.relative_path for r in chunking.chunk_files(rows).collect()] == ["b.py"]


def test_python_that_overflows_the_parser(spark):
    """What the parser gives up on is cut by lines, whole."""
    deep = ["-" * 6000 + "1", "not " * 3000 + "1", "a if b else " * 2000 + "c", "a = " + "1+" * 9000 + "1"]
    rows = spark.createDataFrame([(f"f{k}.py", x) for k, x in enumerate(deep)], "relative_path string, content string")
    found = chunking.chunk_files(rows).orderBy("relative_path", "ordinal").collect()
    assert ["".join(r.content for r in found if r.relative_path == f"f{k}.py") for k in range(len(deep))] == deep


def test_python_lines_that_end_in_carriage_returns():
    raw = "".join(f"def f{k}():\r    return {k}\r" for k in range(40)).encode()
    nodes = chunking.python_nodes(raw)
    assert [raw[a:b] for _, a, b, _ in nodes] == [f"def f{k}():\r    return {k}".encode() for k in range(40)]
    assert chunking.python_nodes(raw.replace(b"\r", b"\r\n"))[1][1] == len(b"def f0():\r\n    return 0\r\n")


def test_trimming_long_runs(spark):
    rows = spark.createDataFrame([("a" + " " * 200_000 + "b \u00a0\n",), (" \u2003 x",), (" ",)], "t string").select(text.trimmed(F.col("t")).alias("t")).collect()
    assert [len(r.t) for r in rows] == [200_002, 1, 0]


IGNORED = [
    ("node_modules", "a/node_modules/x.js", True), ("docs/legacy", "src/docs/legacy/a.md", True), ("/docs", "docs/a.md", True), ("/docs", "src/docs/a.md", False),
    ("**/__generated__/", "a/b/__generated__/x.ts", True), ("*.min.js", "web/a.min.js", True), ("testdata/", "x/testdata/y.go", True), ("!keep.md", "keep.md", False),
    ("[", "[", False), ("a?c", "abc/x", True), ("a/**/c", "a/c", True), ("a/**/c", "a/b/b/c/d", True), ("[^a]b", "cb", True), ("[^a]b", "ab", False), ("x/**", "x/y", True),
]


@pytest.mark.parametrize(("pattern", "path", "hit"), IGNORED)
def test_ignore(pattern, path, hit):
    compiled = ignore.compile_pattern(pattern)
    assert bool(compiled and re.search(compiled, path)) is hit


def test_ignore_column_agrees(spark):
    rows = spark.createDataFrame([(p,) for _, p, _ in IGNORED], "p string")
    for pattern, path, hit in IGNORED:
        assert rows.where(F.col("p") == path).select(ignore.path_ignored(F.col("p"), [pattern])).first()[0] is hit


def test_bytes(spark):
    assert text.repair_bytes(b"a\xff\xfeb\xe2\x82") == "a�b�"
    one = spark.createDataFrame([("é" * 10,)], "c string")
    assert one.select(text.truncated(F.col("c"), 5)).first()[0] == "éé�"
    assert one.select(text.truncated(F.col("c"), 4)).first()[0] == "éé"
    assert one.select(text.truncated(F.col("c"), 99)).first()[0] == "é" * 10


def test_formats(spark):
    results = spark.createDataFrame([(1, "a.go", 7, "x\ny"), (2, "b.go", 1, "z")], "rank int, relative_path string, start_line int, content string")
    expected = "The following code sections were retrieved:\nPath: a.go\n     7  x\n     8  y\n...\n\nPath: b.go\n     1  z\n"
    assert formatting.result_text(results).first().text == expected
    assert formatting.result_text(results.limit(0)).first().text == "No results found.\n"
    assert formatting.copy_all(results).first().text == "// a.go:7\nx\ny\n\n// b.go:1\nz"
    name, tail = formatting.pretty_id(F.col("i"))
    ids = spark.createDataFrame([("sample-150babfd",), ("plain",), ("-x",)], "i string").select(name, tail).collect()
    assert [tuple(r) for r in ids] == [("sample", "150babfd"), ("plain", ""), ("-x", "")]
    sizes = spark.createDataFrame([(5, 59.6), (1536, 61.0), (5 << 20, 3700.0)], "n bigint, s double").select(formatting.human_bytes(F.col("n")), formatting.human_duration(F.col("s"))).collect()
    assert [tuple(r) for r in sizes] == [("5 B", "1m00s"), ("1.5 KiB", "1m01s"), ("5.00 MiB", "1h01m")]


def test_config():
    config = EngineConfig.load({"overlap_bytes": "10", "unknown": 1}, {"QUARRYLINE_OVERLAP_BYTES": "20"})
    assert config.overlap_bytes == 20
    assert [config.top_k(k) for k in (None, 0, -1, 7, 1000)] == [5, 5, 5, 7, 100]
    assert config.recall(5) == 30 and config.recall(20) == 60
    assert first_set("", None, "env", default="d") == "env" and first_set(default="d") == "d"
