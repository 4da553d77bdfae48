"""The engine: pushes, deletes and searches over published generations of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..config import EngineConfig
from ..functions import chunking, formatting
from ..functions import text as T
from ..operators import batching, diff, embedding, retrieval, views
from ..sources import stores, tree
from .store import Store

CHUNKS, POSTINGS, REGISTRY, MANIFEST = "chunks", "postings", "registry", "manifest"
#: Packed batches that one upsert of a sync takes.
SYNC_BATCHES = 200
KEPT = ("chunk_hash", "content", "relative_path", "start_line", "end_line", "language")


class Engine:
    """refresh_lines: give reused chunks the line numbers of the newest push, not those they were stored with."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, provider=None, refresh_lines: bool = False):
        self.spark, self.config, self.refresh_lines = spark, config or EngineConfig(), refresh_lines
        self.provider = provider or self._configured()
        self.store = Store(spark, self.config.index_root)
        self.counters: dict[str, int] = {}

    def _configured(self):
        """The provider that the settings name; settings that are 0 or empty leave its own defaults."""
        c = self.config
        if c.embedding_provider == "hashing":
            return embedding.Hashing(c.embedding_dim)
        options = {"model": c.embedding_model, "dim": c.embedding_dim, "requests_per_second": c.requests_per_second, "tokens_per_minute": float(c.tokens_per_minute)}
        return embedding.provider(c.embedding_provider, c.embedding_key, c.embedding_base, **{k: v for k, v in options.items() if v})

    def collection(self, codebase_id: str) -> str:
        if not codebase_id:
            raise ValueError("a codebase id is needed")
        return self.spark.range(1).select(T.collection_name(F.lit(codebase_id), self.config.index_prefix)).first()[0]

    def chunks(self, codebase_id: str) -> DataFrame:
        return self.store.read(CHUNKS, self.collection(codebase_id), model.STORED)

    def split(self, files: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
        """(chunks worth keeping, one per file and hash; all chunks with drop_reason) of files (relative_path, content).

        Of files that share a path the last in the order of the rows stays.
        """
        files = files.where("relative_path <> ''").withColumn("_n", F.monotonically_increasing_id())
        files = files.groupBy("relative_path").agg(F.max_by("content", "_n").alias("content"))
        cut = chunking.chunk_files(files, self.config)
        cut = cut.withColumn("content", T.truncated(F.col("content"), self.config.max_content_bytes))
        judged = cut.withColumn("drop_reason", T.drop_reason(F.col("content"), self.config.min_chunk_bytes)).withColumn("collection", F.lit(collection))
        kept = judged.where("drop_reason is null").withColumn("chunk_hash", T.chunk_hash(F.col("content")))
        return diff.last_of_equals(kept).withColumn("id", T.chunk_id(F.col("relative_path"), F.col("chunk_hash"))), judged

    def upsert(self, codebase_id: str, files: DataFrame) -> dict[str, int]:
        """Brings the index in line with the pushed files (relative_path, content) and publishes; only new chunks are embedded.

        Counts of files and chunks come back; counters has those of the last upsert besides: the chunks there were (chunks_existing), those
        that were cut (chunks_split) and those left out by reason (dropped_...).
        """
        collection = self.collection(codebase_id)
        if files.isEmpty():
            raise ValueError("files are needed")
        with self.store.writing(collection):
            return self._upsert(collection, codebase_id, files)

    def _upsert(self, collection: str, codebase_id: str, files: DataFrame) -> dict[str, int]:
        self._register(collection, codebase_id)
        pushed = files.where("relative_path <> ''").select(F.lit(collection).alias("collection"), "relative_path")
        old = self.store.read(CHUNKS, collection, model.STORED)
        new, judged = self.split(files, collection)
        reasons = {r.drop_reason: r["count"] for r in judged.groupBy("drop_reason").count().collect()}
        # The split chunks are read three times, by the diff, the embedding and the result: store them once.
        staged = self.store.stage("staging", collection, new.select("collection", "id", "ordinal", *KEPT))
        path = f"{self.store._path('staging', collection)}/{staged}"
        new = self.spark.read.parquet(path)
        changes = diff.chunk_diff(new, old, pushed)
        stats = diff.upsert_stats(changes, pushed).first().asDict()
        fresh = new.join(changes.where("status = 'inserted'"), diff.CHUNK_KEY, "left_semi")
        fresh = retrieval.checked_vectors(embedding.embed_table(fresh.select("collection", "id", *KEPT), self.provider), self.provider.dim)
        stay = old.join(changes.where("status = 'deleted'"), diff.CHUNK_KEY, "left_anti")
        if self.refresh_lines:
            lines = new.select(*diff.CHUNK_KEY, F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
            stay = stay.join(lines, diff.CHUNK_KEY, "left").withColumn("start_line", F.coalesce("_a", "start_line")).withColumn("end_line", F.coalesce("_b", "end_line"))
        columns = ["collection", "id", *KEPT, "vector"]
        self._publish(collection, stay.select(*columns).unionByName(fresh.select(*columns)), fresh_ids=new.join(changes.where("status = 'inserted'"), diff.CHUNK_KEY, "left_semi"), gone=old.join(changes.where("status = 'deleted'"), diff.CHUNK_KEY, "left_semi"))
        self.store.drop("staging", collection)
        self.counters = {"chunks_existing": old.count(), "chunks_split": sum(reasons.values())} | {f"dropped_{k}": n for k, n in reasons.items() if k}
        return {k: int(v) for k, v in stats.items()}

    def _publish(self, collection: str, chunks: DataFrame, fresh_ids: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Writes the chunks and, for what changed, the postings, and publishes both, postings first.

        Postings are sorted by token, so a search reads the row groups of its tokens.
        """
        staged = self.store.stage(CHUNKS, collection, chunks)
        post = self.store.read(POSTINGS, collection, model.POSTING)
        if gone is not None:
            post = retrieval.remove_postings(post, gone.select("collection", F.col("id").alias("chunk_id")))
        if fresh_ids is not None:
            post = retrieval.replace_postings(post, fresh_ids.select("collection", "id", "content"))
        self.store.write(POSTINGS, collection, post.repartitionByRange("token").sortWithinPartitions("token"))
        self.store.publish(CHUNKS, collection, staged)

    def delete_files(self, codebase_id: str, paths: list[str] | DataFrame) -> int:
        """Deletes all chunks of the paths; how many there were."""
        collection = self.collection(codebase_id)
        if isinstance(paths, list):
            paths = self.spark.createDataFrame([(p,) for p in paths], "relative_path string")
        with self.store.writing(collection):
            old = self.store.read(CHUNKS, collection, model.STORED)
            stay, go = diff.delete_files(old, paths.select(F.lit(collection).alias("collection"), "relative_path"))
            gone = go.count()
            if gone:
                self._publish(collection, stay, gone=go)
        return gone

    def search(self, codebase_id: str, query: str, top_k: int | None = None) -> DataFrame:
        """(rank, content, relative_path, start_line, end_line, language, score) of the best chunks."""
        if not query:
            raise ValueError("a query is needed")
        collection = self.collection(codebase_id)
        if self.store.current(CHUNKS, collection) is None:
            raise LookupError(f"nothing is indexed for {codebase_id}")
        self._register(collection, codebase_id)
        vector = [float(x) for x in self.provider.embed([query], embedding.QUERY)[0]]
        queries = self.spark.createDataFrame([(0, collection, query, vector)], "query_id bigint, collection string, query string, query_vector array<float>")
        found = self.search_many(queries, self.chunks(codebase_id), top_k, self.postings(codebase_id))
        return found.select("rank", "content", "relative_path", "start_line", "end_line", "language", "score").orderBy("rank")

    def postings(self, codebase_id: str) -> DataFrame:
        return self.store.read(POSTINGS, self.collection(codebase_id), model.POSTING)

    def search_many(self, queries: DataFrame, chunks: DataFrame, top_k: int | None = None, post: DataFrame | None = None) -> DataFrame:
        """The hybrid ranking of queries (query_id, collection, query, query_vector) over chunks and their postings; without those contents are scanned."""
        k = self.config.top_k(top_k)
        hits = retrieval.vector_hits(queries, chunks, self.config.recall(k))
        found = retrieval.keyword_scan(queries, chunks) if post is None else retrieval.keyword_lookup(queries, retrieval.pruned(post, queries))
        return retrieval.hybrid_of(queries, chunks, hits, found, k, self.config)

    def search_text(self, codebase_id: str, query: str, top_k: int | None = None) -> str:
        return formatting.result_text(self.search(codebase_id, query, top_k)).first().text

    def clear(self, codebase_id: str) -> None:
        """Drops a codebase's index and its registration; nothing where there is none."""
        collection = self.collection(codebase_id)
        with self.store.writing(collection):
            for name in (CHUNKS, POSTINGS, MANIFEST, REGISTRY):
                self.store.drop(name, collection)

    def _register(self, collection: str, codebase_id: str) -> None:
        if self.store.current(REGISTRY, collection) is None:
            self.store.write(REGISTRY, collection, self.spark.createDataFrame([(collection, codebase_id)], model.REGISTRY))

    def _all(self, table: str, schema: str) -> DataFrame:
        paths = [self.store.current(table, c) for c in self.store.collections(table, self.config.index_prefix)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def list_indexes(self) -> DataFrame:
        """(collection, codebase_id, num_chunks, languages) of all indexes."""
        chunks = self._all(CHUNKS, model.STORED)
        languages = views.language_map(views.language_histogram(chunks))
        return views.list_indexes(chunks, self._all(REGISTRY, model.REGISTRY), self.config.index_prefix).join(languages, "collection", "left")

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def sync(self, root: str, codebase_id: str | None = None, progress: Callable[[int, int], None] | None = None, **options) -> dict:
        """Scans a tree, compares it with the last manifest, pushes what changed and deletes what is gone.

        Content is read once, and only of files whose size or time differ; binary and broken files are counted but not pushed. Changed files
        go in batches of batch_files and batch_bytes; the manifest is written after each, so a sync that is cut short goes on
        where it was, and a batch that fails is told in failed, unless most fail. progress is called with the files that are through and all of them.
        """
        codebase_id = codebase_id or stores.derived_id(root)
        collection = self.collection(codebase_id)
        with self.store.writing(collection):
            return self._sync(root, codebase_id, collection, progress or (lambda done, total: None), **options)

    def _sync(self, root: str, codebase_id: str, collection: str, progress: Callable[[int, int], None], **options) -> dict:
        options = {"maxBytes": self.config.max_file_bytes, "ignoreFiles": [".gitignore", self.config.ignore_file]} | options
        seen = tree.scan_tree(self.spark, root, content=False, **options).select(F.lit(codebase_id).alias("codebase_id"), "relative_path", "size", "mtime_ns")
        manifest = self.store.read(MANIFEST, collection, model.MANIFEST)
        look = diff.suspects(seen, manifest)
        read = tree.scan_tree(self.spark, root, content=True, **options).join(look.select("relative_path"), "relative_path", "left_semi")
        # One read serves the hash, the push and the manifest, so a file that changes meanwhile can't mix two states.
        read = self._staged("staging-read", collection, read.select("relative_path", "size", "mtime_ns", "content"))
        seen = seen.join(read.select("relative_path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_time")), "relative_path", "left")
        seen = seen.select("codebase_id", "relative_path", F.coalesce("_size", "size").alias("size"), F.coalesce("_time", "mtime_ns").alias("mtime_ns"))
        hashed = read.select("relative_path", F.sha2("content", 256).alias("sha256"))
        scan = seen.join(hashed, "relative_path", "left")
        changes = self._staged("staging-diff", collection, diff.file_diff(scan, manifest))
        report = {r.status: r.n_files for r in diff.diff_report(changes).collect()}
        removed = changes.where("status = 'removed'").select("relative_path")
        deleted = self.delete_files(codebase_id, removed) if "removed" in report else 0
        plain = ~T.looks_binary(F.col("content")) & F.is_valid_utf8(F.col("content").cast("string"))
        push = read.join(changes.where("status in ('added', 'modified')").select("relative_path"), "relative_path", "left_semi").where(plain)
        push = push.select("relative_path", F.col("content").cast("string").alias("content"))
        sizes = push.select(F.lit(codebase_id).alias("codebase_id"), "relative_path", F.octet_length("content").cast("long").alias("size"))
        packed = self._staged("staging-batches", collection, batching.pack_files(sizes, self.config.batch_bytes, self.config.batch_files))
        turns = {r.turn: r.n for r in packed.groupBy(F.floor(F.col("batch") / SYNC_BATCHES).alias("turn")).agg(F.count("*").alias("n")).collect()}
        stay = changes.where("status not in ('added', 'modified')")
        before = manifest.join(changes.where("status in ('modified')").select("relative_path"), "relative_path", "left_semi")
        columns = ("codebase_id", "relative_path", "sha256", "size", "mtime_ns")
        base = diff.next_manifest(stay).select(*columns)
        # A batch takes SYNC_BATCHES packed ones, so that an upsert has enough to do for all tasks.
        stats, failed, total, files = [], [], 0, 0
        done = packed.limit(0).select("relative_path")
        for turn in sorted(turns):
            first = turn * SYNC_BATCHES
            own = packed.where(F.col("batch").between(first, first + SYNC_BATCHES - 1)).select("relative_path")
            total, files = total + 1, files + turns[turn]
            try:
                stats.append(self.upsert(codebase_id, push.join(own, "relative_path", "left_semi")))
            except Exception as error:
                failed.append((total, str(error)[:500]))
                progress(files, sum(turns.values()))
                continue
            done = done.union(own)
            open_ = before.join(done, "relative_path", "left_anti")
            now = changes.join(done, "relative_path", "left_semi")
            self.store.write(MANIFEST, collection, base.unionByName(now.select(*columns)).unionByName(open_.select(*columns)))
            progress(files, sum(turns.values()))
        if not stats:
            self.store.write(MANIFEST, collection, base.unionByName(before.select(*columns)))
        for name in ("staging-diff", "staging-read", "staging-batches"):
            self.store.drop(name, collection)
        if diff.too_many_failed(len(failed), total):
            raise RuntimeError(f"{len(failed)} of {total} batches failed: {failed[:3]}")
        summed = {k: sum(one[k] for one in stats) for k in (stats[0] if stats else ())}
        return {"report": report, "chunks_deleted": deleted, "upsert": summed, "failed": failed[:3]}

    def _staged(self, name: str, collection: str, rows: DataFrame) -> DataFrame:
        """rows, written once and read back."""
        return self.spark.read.schema(rows.schema).parquet(f"{self.store._path(name, collection)}/{self.store.stage(name, collection, rows)}")
