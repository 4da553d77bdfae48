"""The engine from end to end: pushes, searches, deletes, scans, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarryline.config import EngineConfig
from quarryline.operators import diff, embedding, retrieval
from quarryline.plans.engine import Engine
from quarryline.sources import stores, tree
from quarryline.streaming import ingest

FILE = "relative_path string, content string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(index_root=str(tmp_path / "index"), min_chunk_bytes=10))


def test_upsert_search_delete(spark, engine):
    files = [("a.go", "func createOrder() { return 1 }"), ("b.py", "class Foo:\n    def barBaz(self): pass\n")]
    first = engine.upsert("cb", spark.createDataFrame(files, FILE))
    assert first == {"files_processed": 2, "chunks_processed": 2, "chunks_new_embedded": 2, "chunks_reused": 0, "chunks_deleted": 0}
    again = engine.upsert("cb", spark.createDataFrame(files, FILE))
    assert again["chunks_new_embedded"] == 0 and again["chunks_deleted"] == 0
    best = engine.search("cb", "createOrder").first()
    assert best.relative_path == "a.go" and best.rank == 1
    assert "barBaz" in engine.search_text("cb", "barBaz", 1)
    listed = engine.list_indexes().first()
    assert (listed.codebase_id, listed.num_chunks, listed.languages) == ("cb", 2, {"go": 1, "python": 1})
    assert engine.delete_files("cb", ["a.go", "none"]) == 1
    assert engine.upsert("cb", spark.createDataFrame([("b.py", "  ")], FILE))["chunks_deleted"] == 1
    engine.clear("cb")
    engine.clear("cb")
    assert engine.list_indexes().isEmpty()
    with pytest.raises(LookupError):
        engine.search("cb", "x")
    with pytest.raises(ValueError):
        engine.search("cb", "")


def test_scores(spark):
    hits = spark.createDataFrame([(0, "c1", 0.8), (0, "c2", 0.4)], "query_id int, chunk_id string, cos double")
    found = spark.createDataFrame([(0, "c2", 15), (0, "c3", 4), (0, "c4", 40)], "query_id int, chunk_id string, tf bigint")
    chunks = spark.createDataFrame([("x", f"c{i}", "p", 1, 1, "go", "t") for i in (1, 2, 3, 4)], "collection string, id string, relative_path string, start_line int, end_line int, language string, content string")
    queries = spark.createDataFrame([(0, "x", "q")], "query_id int, collection string, query string")
    got = retrieval.hybrid_of(queries, chunks, hits, found, 4).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("c1", 0.8), ("c2", 0.6), ("c4", 0.5), ("c3", 0.36)]


def test_clustered_hits_find_all_with_all_probes(spark):
    chunks = spark.createDataFrame([("x", f"c{i}", [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "collection string, id string, vector array<float>")
    queries = spark.createDataFrame([(0, "x", [1.0, 2.0, 0.5])], "query_id int, collection string, query_vector array<float>")
    exact = retrieval.vector_hits(queries, chunks, 7).collect()
    near = retrieval.clustered_hits(queries, chunks, 7, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 3).collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, near))


def test_bad_vectors_raise(spark):
    rows = spark.createDataFrame([([1.0, None],)], "vector array<float>")
    with pytest.raises(Exception, match="not a vector"):
        retrieval.checked_vectors(rows, 2).collect()


def test_tree_scan_and_sync(spark, engine, tmp_path):
    root = tmp_path / "src"
    for path, body in (("pkg/__init__.py", "x = 1234567890\n"), (".eslintrc.js", "module.exports = {}"), ("pkg/a.go", "package main\nfunc A() {}"), ("pkg/.hid/x.go", "no"), ("node_modules/z.js", "no"), ("bin.go", "a\0bbbbbbbbbbbbbbb"), ("old/b.go", "no")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    (root / ".gitignore").write_text("# c\n\nold/\n")
    seen = {r.relative_path for r in tree.scan_tree(spark, str(root)).collect()}
    assert seen == {"pkg/__init__.py", ".eslintrc.js", "pkg/a.go", "bin.go"}
    seen = []
    first = engine.sync(str(root), "t", progress=lambda done, total: seen.append((done, total)))
    assert seen and seen[-1][0] == seen[-1][1]
    assert first["report"] == {"added": 4} and first["upsert"]["files_processed"] == 3
    assert engine.sync(str(root), "t")["report"] == {"added": 1, "unchanged": 3}
    os.remove(root / "pkg/a.go")
    assert engine.sync(str(root), "t")["chunks_deleted"] == 1


def test_stream_equals_batch(spark, engine, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    changes = []
    for k in range(3):
        rows = [{"seq": k * 10 + i, "op": "delete" if (k, i) == (2, 0) else "upsert", "codebase_id": "s", "relative_path": f"f{i}.py", "content": f"value_{k}_{i} = compute({i})\n"} for i in range(3)]
        (feed / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(feed / f"{k}.json", (1_700_000_000 + k * 100,) * 2)
        changes += rows
    query = ingest.ingest(engine, ingest.read_changes(spark, str(feed), 1), str(tmp_path / "check"))
    query.awaitTermination()
    assert query.exception() is None
    streamed = {(r.relative_path, r.id) for r in engine.chunks("s").collect()}
    other = Engine(spark, EngineConfig(index_root=str(tmp_path / "batch"), min_chunk_bytes=10))
    frame = spark.createDataFrame([tuple(r.values()) for r in changes], "seq bigint, op string, codebase_id string, relative_path string, content string")
    assert ingest.apply_changes(other, frame) == []
    assert streamed == {(r.relative_path, r.id) for r in other.chunks("s").collect()}
    assert {p for p, _ in streamed} == {"f1.py", "f2.py"}


def test_json_stores(spark, tmp_path):
    manifest = spark.createDataFrame([("c", "a.go", "h", 5, 7)], "codebase_id string, relative_path string, sha256 string, size bigint, mtime_ns bigint")
    path = str(tmp_path / "manifest.json")
    assert stores.read_manifest(spark, path, "c").isEmpty()
    stores.write_manifest(manifest, path)
    assert stores.read_manifest(spark, path, "c").collect() == manifest.collect()
    registry = str(tmp_path / "registry.json")
    (tmp_path / "registry.json").write_text('{"ql_1": "old-id"}')
    assert [(r.collection, r.codebase_id) for r in stores.read_registry(spark, registry).collect()] == [("ql_1", "old-id")]
    rows = spark.createDataFrame([("ql_2", "new", {"go": 3})], "collection string, codebase_id string, languages map<string,bigint>")
    assert stores.write_registry(rows, registry) and not stores.write_registry(rows, registry)
    assert stores.read_registry(spark, registry).collect() == rows.collect()


def test_providers():
    asked = []

    def post(url, body, headers, timeout):
        asked.append(json.loads(body))
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(asked[-1]["input"])))]}).encode()

    service = embedding.provider("openai", key="k", dim=2, batch=2, post=post)
    assert service.embed(["a", "bb", "ccc"]) == [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]]
    assert [len(a["input"]) for a in asked] == [2, 1]
    with pytest.raises(embedding.EmbeddingError):
        embedding.checked([[1.0]], 2, 1)
    with pytest.raises(ValueError):
        embedding.provider("voyageai")
    assert list(embedding.batches_of(["a" * 30, "b" * 300, "c"], 128, 100)) == [["a" * 30], ["b" * 300], ["c"]]
    now, slept = [0.0], []
    bucket = embedding.Bucket(2.0, 2.0, lambda: now[0], slept.append)
    for _ in range(3):
        bucket.take(1)
    assert slept == [0.5]


def test_upsert_in_parts_ends_alike(spark, tmp_path):
    files = [(f"f{i}.py", f"name_{i} = value_{i % 3}\nother = {i}\n") for i in range(9)]
    whole, parts = (Engine(spark, EngineConfig(index_root=str(tmp_path / n), min_chunk_bytes=5)) for n in ("whole", "parts"))
    whole.upsert("c", spark.createDataFrame(files, FILE))
    for k in range(0, 9, 4):
        parts.upsert("c", spark.createDataFrame(files[k : k + 4], FILE))
    assert {r.id for r in whole.chunks("c").collect()} == {r.id for r in parts.chunks("c").collect()}


def test_small_operators(spark):
    failures = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, "d")], "batch int, error string")
    assert [r.batch for r in diff.first_failures(failures).collect()] == [1, 2, 3]
    assert diff.too_many_failed(3, 5) and not diff.too_many_failed(2, 4)
    sums = diff.sum_results(spark.createDataFrame([(1, 2, 3, 4, 5), (1, 1, 1, 1, 1)], "files_processed int, chunks_processed int, chunks_new_embedded int, chunks_reused int, chunks_deleted int"))
    assert tuple(sums.first()) == (2, 3, 4, 5, 6)
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_counters_and_stored_postings(spark, engine):
    files = [("a.go", "func createOrder() { return 1 }"), ("b.py", "# only a comment here"), ("c.py", "total = createOrder(3)\n")]
    engine.upsert("cb", spark.createDataFrame(files, FILE))
    assert engine.counters == {"chunks_existing": 0, "chunks_split": 3, "dropped_comments": 1}

    def same():
        kept = sorted(map(tuple, engine.postings("cb").select("chunk_id", "token", "tf").collect()))
        assert kept == sorted(map(tuple, retrieval.postings(engine.chunks("cb")).select("chunk_id", "token", "tf").collect())) and kept

    same()
    engine.upsert("cb", spark.createDataFrame([("c.py", "other = createOrder(4)\n")], FILE))
    assert engine.counters["chunks_existing"] == 2
    same()
    engine.delete_files("cb", ["a.go"])
    same()
    plan = engine.search("cb", "other createOrder")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(token" in plan
    assert engine.search("cb", "other createOrder").first().relative_path == "c.py"


def test_readers_keep_their_generation(spark, engine):
    engine.upsert("cb", spark.createDataFrame([("a.go", "func createOrder() { return 1 }")], FILE))
    before = engine.search("cb", "createOrder")
    engine.upsert("cb", spark.createDataFrame([("a.go", "func dropOrder() { return 2 }")], FILE))
    assert "createOrder" in before.first().content
    assert "dropOrder" in engine.search("cb", "dropOrder").first().content


def test_writers_wait_for_each_other(spark, engine):
    with engine.store.writing("x"):
        other = Engine(spark, engine.config)
        with pytest.raises(TimeoutError), other.store.writing("x", wait=0.3):
            pass
        with engine.store.writing("x"):
            pass
    with other.store.writing("x", wait=0.3):
        pass


def test_the_last_pushed_file_wins(spark, engine):
    files = [("a.py", "zeta_value = 1111"), ("b.py", "other_value = 1"), ("a.py", "alpha_value = 2222")]
    engine.upsert("cb", spark.createDataFrame(files, FILE).coalesce(1))
    assert {r.content for r in engine.chunks("cb").collect()} == {"alpha_value = 2222", "other_value = 1"}


def test_sync_goes_on_after_a_failed_batch(spark, tmp_path, monkeypatch):
    """What a batch pushed is remembered, what failed is pushed next time."""
    from quarryline.plans import engine as engines

    monkeypatch.setattr(engines, "SYNC_BATCHES", 1)
    engine = Engine(spark, EngineConfig(index_root=str(tmp_path / "index"), min_chunk_bytes=5, batch_files=2))
    root = tmp_path / "src"
    root.mkdir()
    for i in range(5):
        (root / f"f{i}.py").write_text(f"value_{i} = compute({i})\n")
    upsert, calls = engine.upsert, []

    def sometimes(codebase, files):
        calls.append(sorted(r.relative_path for r in files.collect()))
        if len(calls) == 2:
            raise RuntimeError("no")
        return upsert(codebase, files)

    monkeypatch.setattr(engine, "upsert", sometimes)
    first = engine.sync(str(root), "t")
    assert calls == [["f0.py", "f1.py"], ["f2.py", "f3.py"], ["f4.py"]]
    assert first["upsert"]["files_processed"] == 3 and first["failed"] == [(2, "no")]
    second = engine.sync(str(root), "t")
    assert calls[3:] == [["f2.py", "f3.py"]] and second["report"] == {"added": 2, "unchanged": 3}
    assert engine.chunks("t").count() == 5


def test_failed_changes_do_not_vanish(spark, engine, tmp_path, monkeypatch):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [{"seq": i, "op": "upsert", "codebase_id": c, "relative_path": "f.py", "content": f"value_{c} = compute({i})\n"} for i, c in enumerate("abc")]
    (feed / "0.json").write_text("\n".join(map(json.dumps, rows)))
    upsert = engine.upsert
    monkeypatch.setattr(engine, "upsert", lambda c, f: 1 / 0 if c == "b" else upsert(c, f))
    query = ingest.ingest(engine, ingest.read_changes(spark, str(feed)), str(tmp_path / "c1"))
    with pytest.raises(Exception, match="codebases failed"):
        query.awaitTermination()
    query = ingest.ingest(engine, ingest.read_changes(spark, str(feed)), str(tmp_path / "c2"), str(tmp_path / "aside"))
    query.awaitTermination()
    assert [r.codebase_id for r in spark.read.json(str(tmp_path / "aside")).collect()] == ["b"]


def test_fitted_centres(spark):
    chunks = spark.createDataFrame([("x", f"c{i}", [1.0, float(i % 7), float(i % 4)]) for i in range(80)], "collection string, id string, vector array<float>")
    queries = spark.createDataFrame([(0, "x", [1.0, 3.0, 2.0])], "query_id int, collection string, query_vector array<float>")
    centres = retrieval.fitted_centres(chunks, 12)
    assert len(centres) == 12 and retrieval.fitted_centres(chunks.limit(0)) == []
    exact = {r.chunk_id for r in retrieval.vector_hits(queries, chunks, 10).collect()}
    assert len(exact & {r.chunk_id for r in retrieval.clustered_hits(queries, chunks, 10, centres, 6).collect()}) >= 9


def test_many_queries_are_dealt_alike(spark, monkeypatch):
    chunks = spark.createDataFrame([("x", f"c{i}", [1.0, float(i % 7), float(i % 4)]) for i in range(80)], "collection string, id string, vector array<float>")
    queries = spark.createDataFrame([(k, "x", [1.0, float(k), 2.0]) for k in range(4)], "query_id int, collection string, query_vector array<float>")
    few = sorted(map(tuple, retrieval.vector_hits(queries, chunks, 5).collect()))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 2)
    assert few == sorted(map(tuple, retrieval.vector_hits(queries, chunks, 5).collect())) and len(few) == 20


def test_a_task_shares_one_rate():
    slept = []
    service = embedding.provider("openai", key="k", dim=1, requests_per_second=2.0, post=lambda u, body, h, t: json.dumps({"data": [{"index": 0, "embedding": [1.0]}]}).encode())
    service.embed(["a"])
    service.buckets[0].sleep, service.buckets[0].clock = slept.append, lambda: service.buckets[0].last
    service.embed(["a"])
    service.embed(["a"])
    assert slept and sum(slept) >= 0.4


def test_settings_name_the_provider(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("index_root: /x\nembedding:\n  provider: openai\n  key: k\n  dim: 8\ntokens_per_minute: 600\n")
    config = EngineConfig.load({"index_root": str(tmp_path)}, {}, file=str(tmp_path / "s.yaml"))
    assert (config.index_root, config.embedding_provider, config.embedding_dim) == (str(tmp_path), "openai", 8)
    service = Engine(spark, config).provider
    assert (service.name, service.dim, service.tokens_per_minute) == ("openai", 8, 600.0)
