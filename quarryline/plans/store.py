"""Tables of an index as generations: written beside what readers see, then published by one rename.

<root>/<table>/collection=<c>/gen-<n>/ holds Parquet files, <root>/<table>/collection=<c>/CURRENT names the one that holds.
A reader resolves CURRENT once and so sees one snapshot; nothing is written to a path that a plan reads, and the KEPT generations before
the published one stay for plans that still read them. Writers of a collection hold a lock file, so no update is lost; one that is
older than STALE seconds was left by a writer that died. Paths go through Hadoop's file system, so any store that Spark writes to will do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

KEPT, STALE = 3, 6 * 3600.0


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._held: set[str] = set()

    @contextmanager
    def writing(self, collection: str, wait: float = 600.0, every: float = 0.2) -> Iterator[None]:
        """Holds the collection's lock; a writer that holds it already goes on. Raises TimeoutError after `wait` seconds."""
        if collection in self._held:
            yield
            return
        fs, p = self._fs(f"{self.root}/locks/{collection}")
        end = time.monotonic() + wait
        while True:
            try:
                fs.create(p, False).close()
                break
            except Py4JJavaError as error:
                if not fs.exists(p) and "AlreadyExists" not in str(error):
                    raise
            if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE:
                fs.delete(p, False)
            elif time.monotonic() > end:
                raise TimeoutError(f"{collection} is being written")
            else:
                time.sleep(every)
        self._held.add(collection)
        try:
            yield
        finally:
            self._held.discard(collection)
            fs.delete(p, False)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _path(self, table: str, collection: str) -> str:
        return f"{self.root}/{table}/collection={collection}"

    def current(self, table: str, collection: str) -> str | None:
        """The folder that holds the published rows."""
        fs, p = self._fs(f"{self._path(table, collection)}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self._path(table, collection)}/{name}"

    def read(self, table: str, collection: str, schema: str) -> DataFrame:
        """The published rows; none where nothing was."""
        path = self.current(table, collection)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def stage(self, table: str, collection: str, rows: DataFrame) -> str:
        """Writes a generation that no reader sees yet."""
        name = f"gen-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._path(table, collection)}/{name}")
        return name

    def publish(self, table: str, collection: str, name: str) -> None:
        """Makes a staged generation the one that readers see; all but the KEPT published before it are dropped."""
        base = self._path(table, collection)
        fs, temporary = self._fs(f"{base}/CURRENT-{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(name.encode()))
        out.close()
        _, pointer = self._fs(f"{base}/CURRENT")
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        context.rename(fs.makeQualified(temporary), fs.makeQualified(pointer), overwrite)
        _, folder = self._fs(base)
        before = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("gen-") and s.getPath().getName() != name]
        for old in sorted(before, key=lambda s: -s.getModificationTime())[KEPT:]:
            fs.delete(old.getPath(), True)

    def write(self, table: str, collection: str, rows: DataFrame) -> None:
        self.publish(table, collection, self.stage(table, collection, rows))

    def collections(self, table: str, prefix: str = "") -> list[str]:
        """Names of the collections that have published rows."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName().removeprefix("collection=") for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith(prefix) and self.current(table, n))

    def drop(self, table: str, collection: str) -> bool:
        fs, p = self._fs(self._path(table, collection))
        return bool(fs.delete(p, True)) if fs.exists(p) else False
