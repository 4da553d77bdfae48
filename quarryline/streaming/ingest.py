"""A change feed as a stream: every micro-batch of pushes and deletes becomes one published generation per codebase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from .. import model
from ..operators.diff import too_many_failed
from ..plans.engine import Engine


def read_changes(spark: SparkSession, path: str, files_per_trigger: int = 50) -> DataFrame:
    """JSON lines (seq, op, codebase_id, relative_path, content) as a stream."""
    return spark.readStream.schema(model.CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def apply_changes(engine: Engine, changes: DataFrame) -> list[dict]:
    """Applies a batch: of each file the last change by seq holds. What fails for a codebase is returned, not raised, unless most fail."""
    last = F.row_number().over(Window.partitionBy("codebase_id", "relative_path").orderBy(F.desc("seq")))
    final = changes.withColumn("_n", last).where("_n = 1").drop("_n").persist()
    failed, total = [], 0
    try:
        for row in final.select("codebase_id").distinct().toLocalIterator():
            own = final.where(F.col("codebase_id") == row.codebase_id)
            total += 1
            try:
                gone = own.where("op = 'delete'").select("relative_path")
                if not gone.isEmpty():
                    engine.delete_files(row.codebase_id, gone)
                push = own.where("op = 'upsert'").select("relative_path", "content")
                if not push.isEmpty():
                    engine.upsert(row.codebase_id, push)
            except Exception as error:
                failed.append({"codebase_id": row.codebase_id, "error": str(error)[:500]})
    finally:
        final.unpersist()
    if too_many_failed(len(failed), total):
        raise RuntimeError(f"{len(failed)} of {total} codebases failed: {failed[:3]}")
    return failed


def ingest(engine: Engine, changes: DataFrame, checkpoint: str, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Starts the stream. Ids depend on content alone, so a batch that runs again after a fault changes nothing.

    Changes of codebases that failed go to the folder quarantine; without one the batch fails and is run again.
    """

    def batch(frame: DataFrame, number: int) -> None:
        failed = apply_changes(engine, frame)
        if failed and not quarantine:
            raise RuntimeError(f"{len(failed)} codebases failed: {failed[:3]}")
        if failed:
            ids = [f["codebase_id"] for f in failed]
            frame.where(F.col("codebase_id").isin(ids)).withColumn("batch", F.lit(number)).write.mode("append").json(quarantine)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
