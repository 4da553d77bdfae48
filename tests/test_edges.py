"""The highlighter, the command line and batches of large codebases."""

import hashlib
import random

from quarryline import cli
from quarryline.config import EngineConfig
from quarryline.functions import highlight
from quarryline.operators import batching
from quarryline.plans import registry
from quarryline.plans.engine import Engine


def test_highlight():
    code = 'func f1() { // note\n  return "a\\"b" + 0x1F /* x\ny */\n}'
    got = list(highlight.tokens(code, "go"))
    assert ("func", "keyword") in got and ("// note", "comment") in got and ('"a\\"b"', "string") in got and ("0x1F", "number") in got and ("/* x\ny */", "comment") in got
    assert "".join(t for t, _ in got) == code
    assert list(highlight.tokens("x = 'a # b' # c", "python")) == [("x = ", "plain"), ("'a # b'", "string"), (" ", "plain"), ("# c", "comment")]
    assert list(highlight.tokens("'open\nif", "sql")) == [("'open", "string"), ("\n", "plain"), ("if", "keyword")]
    assert list(highlight.tokens("--[[ a\nb ]] x -- y", "lua"))[0] == ("--[[ a\nb ]]", "comment")
    assert [x[:2] for x in highlight.highlight("a\n\nif b", "go")] == [(1, 0), (3, 0), (3, 1)]
    assert list(highlight.highlight(None, None)) == []


def test_highlight_in_sql(spark):
    highlight.register(spark)
    rows = spark.sql("SELECT h.line, h.text, h.class FROM VALUES ('if x', 'go') AS t(c, l), LATERAL highlight(c, l) h ORDER BY h.place").collect()
    assert [tuple(r) for r in rows] == [(1, "if", "keyword"), (1, " x", "plain")]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def orderTotal(items):\n    return sum(items)\n" + "# pad\n" * 20)
    engine = Engine(spark, EngineConfig(index_root=str(tmp_path / "index"), min_chunk_bytes=10))
    for words in (["sync"], ["search", "--top-k", "1", "orderTotal"], ["status"], ["list"], ["clear"]):
        assert cli.run(engine, cli.parser().parse_intermixed_args(words), str(tmp_path / "src"), "demo") == 0
    said = capsys.readouterr().out
    assert "a.py:1-" in said and "1 chunks" in said and "cleared demo" in said
    assert cli.main(["init", "--root", str(tmp_path), "my-id"]) == 0 and cli.main(["version"]) == 0
    assert "my-id" in capsys.readouterr().out


def test_batches_do_not_depend_on_the_block(spark):
    """A codebase that is cut into parts is packed as one sequence in path order."""
    rng = random.Random(6)
    rows = [(c, f"d{rng.randrange(9)}/f{i}", rng.choice([0, 1, 5, 30, 40, 120])) for c, n in (("a", 400), ("b", 3), (None, 90)) for i in range(n)]
    expected = {}
    for c in ("a", "b", None):
        batch = size = items = 0
        for path, n in sorted((p, n) for d, p, n in rows if d == c):
            if items and (size + n > 100 or items >= 6):
                batch, size, items = batch + 1, 0, 0
            size, items = size + n, items + 1
            expected[c, path] = (n, batch)
    frame = spark.createDataFrame(rows, "codebase_id string, relative_path string, size long")
    for block in (10_000, 40, 3):
        found = batching.pack_files(frame, 100, 6, block).collect()
        assert len(found) == len(rows) and {(r.codebase_id, r.relative_path): (r["size"], r.batch) for r in found} == expected


def test_identity_of_long_files(spark, tmp_path):
    """Files that differ after 60,000 bytes are different chunks."""
    texts = ["a" * 70_000 + c for c in "xy"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.chunk_identity(spark, str(tmp_path)).collect()
    assert {(r.chunk_hash, r.bytes) for r in found} == {(hashlib.sha256(t.encode()).hexdigest(), 70_001) for t in texts}
