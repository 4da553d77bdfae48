"""Harmonic packing of tokenized documents into sequences of fixed capacity.

A document is cut into full sequences and pieces whose lengths are those of the harmonic classes:
the largest floor(capacity / m) that fits, again and again, for m up to CLASSES; what is then left is
shorter than capacity / CLASSES and is a class by its own length. A class of length L fills
its sequences with capacity // L pieces each. Pieces are numbered by (class, bucket of the document), every
bucket on its own, and offset by the counts of earlier buckets, so one part-filled sequence is left per
class, not one per worker; those leftovers, at most one sequence's worth a class whatever the input,
are packed together by decreasing length.

Defined cases: null text is empty and has only the end id; empty tables give an empty result; rows that
repeat a doc_id are documents of their own, and a null doc_id is kept; very long texts are cut like others; further columns are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bpe import loaded
from ._shared import materialize, table
from ._words import in_slices

CAPACITY, END_ID, CLASSES = 2048, 1, 32
#: Buckets of pieces at least, and pieces of a bucket at most on average.
BUCKETS, PER_BUCKET = 256, 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > capacity // classes:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens) of every piece of docs (doc_id, text); row tells copies of an id apart."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for part in in_slices(batch):
                found = bpe.texts(part.column(1))
                ends = found.ends + np.arange(1, part.num_rows + 1)
                ids = np.full(int(ends[-1]) if len(ends) else 0, END_ID, "<u4")
                inside = np.ones(len(ids), bool)
                inside[ends - 1] = False
                ids[inside] = found.ids
                cut = [lengths(int(n), capacity) for n in np.diff(ends, prepend=0)]
                of = np.repeat(np.arange(part.num_rows), [len(x) for x in cut])
                length = np.concatenate([np.array(x, np.int64) for x in cut]) if cut else np.empty(0, np.int64)
                stop = np.cumsum(length)
                begin = (ends - np.diff(ends, prepend=0))[of]
                crc = np.fromiter((zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(stop, length, strict=True)), np.int64, len(length))
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(2).take(rows), pa.array(stop - length - begin), pa.array(length), pa.array(crc), pa.array(np.diff(ends, prepend=0)[of])],
                    names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
                )

    slim = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return slim.mapInArrow(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, row, start, length, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    own = pieces.columns
    buckets = max(BUCKETS, math.ceil(pieces.count() / PER_BUCKET))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(buckets)))
    # At most `capacity` classes: sums by class fit on the driver at any size of the input.
    by_class = sorted((r.length, r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect())
    base, rows = 0, []
    for length, n in by_class:
        per = capacity // length
        rows.append((length, per, base, n // per * per))
        base += n // per
    classes = spark.createDataFrame(rows, "length long, per long, first long, full long")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "row")
    placed = pieces.withColumn("inner", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"]).join(F.broadcast(classes), "length")
    index = F.col("inner") + F.col("base")
    placed = placed.select(*own, index.alias("index"), "per", "first", "full")
    filled = placed.where("index < full").select(
        *own, (F.col("first") + F.expr("index div per")).alias("sequence_id"), ((F.col("index") % F.col("per")) * F.col("length")).alias("offset")
    )
    rest = placed.where("index >= full").select(*own)

    def tail(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True])
        room, where, at = [], [], []
        open_by: dict[int, list[int]] = {}
        for n in frame["length"]:
            fit = next((r for r in range(int(n), capacity + 1) if open_by.get(r)), None)
            bin_ = open_by[fit].pop() if fit is not None else len(room)
            if fit is None:
                room.append(capacity)
            where.append(base + bin_)
            at.append(capacity - room[bin_])
            room[bin_] -= int(n)
            if room[bin_]:
                open_by.setdefault(room[bin_], []).append(bin_)
        return frame.assign(sequence_id=np.array(where, np.int64), offset=np.array(at, np.int64))

    schema = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", sequence_id long, offset long"
    # Bounded: a class leaves less than a sequence, and there are at most capacity // CLASSES + CLASSES classes.
    packed = rest.withColumn("tail", F.lit(0)).groupBy("tail").applyInPandas(lambda f: tail(f.drop(columns="tail")), schema)
    return filled.unionByName(packed)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = materialize(tokenized(docs, path, capacity), "pack-pieces")
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
