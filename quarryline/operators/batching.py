"""Order-dependent packing into batches, as folds over ordered arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _full(acc: Column, size: Column, most_bytes: int, most_items: int) -> Column:
    return (acc["items"] > 0) & ((acc["bytes"] + size > most_bytes) | (acc["items"] >= most_items))


def _put(acc: Column, size: Column, most_bytes: int, most_items: int) -> Column:
    """acc (batch, bytes, items of the open batch) after one more item."""
    full = _full(acc, size, most_bytes, most_items)
    return F.struct(
        (acc["batch"] + full.cast("bigint")).alias("batch"),
        (F.when(full, F.lit(0).cast("bigint")).otherwise(acc["bytes"]) + size).alias("bytes"),
        (F.when(full, 0).otherwise(acc["items"]) + 1).alias("items"),
    )


def _opened(batch: Column | int = 0, size: Column | int = 0, items: Column | int = 0) -> Column:
    """The state of an open batch; nothing was put in before the first item."""
    batch, size, items = (x if isinstance(x, Column) else F.lit(x) for x in (batch, size, items))
    return F.struct(batch.cast("bigint").alias("batch"), size.cast("bigint").alias("bytes"), items.cast("int").alias("items"))


def greedy_batches(sizes: Column, most_bytes: int, most_items: int, opened: Column | None = None) -> Column:
    """Batch number of every element of an ordered array of sizes: a new batch where bytes would pass the limit or it is full."""
    start = F.struct((_opened() if opened is None else opened).alias("open"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        after = _put(acc["open"], size, most_bytes, most_items)
        return F.struct(after.alias("open"), F.concat(acc["out"], F.array(after["batch"])).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _rank(cuts: Column, path: Column) -> Column:
    """How many of the sorted cuts are at most path, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(cuts, middle) <= path
        return F.when(acc["low"] >= acc["high"], acc).otherwise(
            F.struct(F.when(less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(middle).alias("high"))
        )

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high")), halve, lambda acc: acc["low"])


def _carried(parts: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """(codebase_id, part, open): the batch that is open where each part of a codebase begins.

    For each of its first files, a part says what is open at its end if a new batch starts there; a batch
    that an earlier part left open ends within the first most_files files, so these answers are chained.
    """
    sizes = F.transform("rows", lambda r: r["size"])
    begins = F.sequence(F.lit(0), F.least(F.size("rows") - 1, F.lit(most_files)))
    ends = F.transform(begins, lambda e: F.aggregate(F.slice(sizes, e + 1, F.size("rows")), _opened(), lambda acc, s: _put(acc, s, most_bytes, most_files)))
    told = parts.select("codebase_id", F.struct("part", F.slice(sizes, 1, most_files + 1).alias("head"), ends.alias("ends")).alias("told"))

    def walk(acc: Column, size: Column) -> Column:
        done = acc["done"] | _full(acc, size, most_bytes, most_files)
        return F.when(done, F.struct(acc["batch"], acc["bytes"], acc["items"], acc["at"], F.lit(True).alias("done"))).otherwise(
            F.struct(acc["batch"], (acc["bytes"] + size).alias("bytes"), (acc["items"] + 1).alias("items"), (acc["at"] + 1).alias("at"), F.lit(False).alias("done"))
        )

    def chain(acc: Column, one: Column) -> Column:
        now = acc["open"]
        start = F.struct(now["batch"].alias("batch"), now["bytes"].alias("bytes"), now["items"].alias("items"), F.lit(0).alias("at"), F.lit(False).alias("done"))
        met = F.aggregate(one["head"], start, walk)
        end = F.get(one["ends"], met["at"])
        after = F.when(met["done"], _opened(met["batch"] + 1 + end["batch"], end["bytes"], end["items"])).otherwise(_opened(met["batch"], met["bytes"], met["items"]))
        return F.struct(after.alias("open"), F.concat(acc["out"], F.array(F.struct(one["part"].alias("part"), now.alias("open")))).alias("out"))

    grouped = told.groupBy("codebase_id").agg(F.array_sort(F.collect_list("told")).alias("told"))
    empty = F.array().cast("array<struct<part:int,open:struct<batch:bigint,bytes:bigint,items:int>>>")
    found = grouped.select("codebase_id", F.explode(F.aggregate("told", F.struct(_opened().alias("open"), empty.alias("out")), chain, lambda acc: acc["out"])).alias("z"))
    return found.select("codebase_id", "z.part", "z.open")


def pack_files(files: DataFrame, most_bytes: int = 5 << 20, most_files: int = 50, block: int = 10_000) -> DataFrame:
    """files (codebase_id, relative_path, size) with batch: greedy over each codebase's files in path order.

    A codebase is cut by path into parts of about `block` files, at paths chosen by hash, and the open batch is carried from part to
    part, so the batches are those of one sequence and no task holds a whole codebase.
    """
    chosen = files.where(F.pmod(F.xxhash64("relative_path"), F.lit(block)) == 0)
    cuts = chosen.groupBy("codebase_id").agg(F.array_sort(F.collect_set("relative_path")).alias("cuts")).select(F.col("codebase_id").alias("of"), "cuts")
    part = F.when(F.col("cuts").isNull(), 0).otherwise(_rank(F.col("cuts"), F.col("relative_path")))
    spread = files.join(F.broadcast(cuts), F.col("codebase_id").eqNullSafe(F.col("of")), "left").withColumn("part", part.cast("int"))
    row = F.struct("relative_path", F.col("size").cast("bigint").alias("size"))
    parts = spread.groupBy("codebase_id", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max(F.col("cuts").isNotNull()).alias("more"))
    opened = _carried(parts.where("more"), most_bytes, most_files).select(F.col("codebase_id").alias("of"), F.col("part").alias("at"), "open")
    known = parts.join(opened, F.col("codebase_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    numbered = known.withColumn("batches", greedy_batches(F.transform("rows", lambda r: r["size"]), most_bytes, most_files, F.coalesce("open", _opened())))
    one = numbered.select("codebase_id", F.explode(F.arrays_zip("rows", "batches")).alias("z"))
    return one.select("codebase_id", "z.rows.relative_path", "z.rows.size", F.col("z.batches").alias("batch"))


def fixed_batches(index: Column, size: int = 100) -> Column:
    """Batch number of a row's index from 0."""
    return F.floor(index / size).cast("bigint")
