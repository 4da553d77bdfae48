"""Mixing sources to target weights by fixed-length blocks.

The words of a source, its documents in a fixed order, are cut into blocks of equal length, the same for all but small sources,
whose blocks are shorter so that they too come near their targets. Every
output shard draws its slots per source by a multinomial over what the sources still have to give.
A slot goes through a pseudorandom permutation of the source's block indices, a pass at a time, so
no block repeats before all were used once; blocks join the slots by index.

Sums of sizes are the only thing on the driver: one row per source, and per shard and source.
Documents are numbered by (source, bucket of the id), BUCKETS or more buckets, so a source
with a third of all rows is spread over as many tasks.

Defined cases: null text has size 0 and takes no words; a null source is a source of its own, last in
order; the empty string is an ordinary source. Rows that repeat a doc_id are rows of their own, in the order of
their size and text. Very long texts are cut into blocks like others. An empty table gives an empty result. Further columns of the
input are left out by mix() and mixed_shards(), and kept, whatever their names, by mixed_documents().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import fresh, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; share of all words; most a source gives, times its size.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words of a block at least and at most; a source is cut into BLOCKS blocks between these lengths.
SHORTEST, LONGEST, BLOCKS = 1, 4096, 4096
#: Output shards at most, and slots of one at least.
SHARDS, SLOTS = 256, 256
#: Buckets of documents at least, and documents of a bucket at most on average.
BUCKETS, PER_BUCKET = 256, 20_000
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source in order: by weight, at most most times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def shard_counts(slots: list[int], seed: int = SEED) -> list[list[int]]:
    """Slots per shard and source: multinomial draws over what remains, so the shards add up to slots."""
    left, rng = np.array(slots, dtype=np.int64), np.random.default_rng(seed)
    total = int(left.sum())
    shards = max(1, min(SHARDS, total // SLOTS))
    out = []
    for k in range(shards):
        want = total // shards + (k < total % shards)
        got = np.zeros_like(left)
        while want:
            draw = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got, left, want = got + draw, left - draw, want - int(draw.sum())
        out.append(got.tolist())
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at x: Feistel rounds over a * b >= n cells, walked back into range."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)
    y = x.astype(np.uint64)
    out = np.ones(len(y), dtype=bool)
    while out.any():
        left, right = y[out] // np.uint64(b), y[out] % np.uint64(b)
        for r in range(4):
            if r % 2 == 0:
                left = (left + _mixed(right, key + r) % np.uint64(a)) % np.uint64(a)
            else:
                right = (right + _mixed(left, key + r) % np.uint64(b)) % np.uint64(b)
        y[out] = left * np.uint64(b) + right
        out[out] = y[out] >= n
    return y.astype(np.int64)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    z = x + np.uint64((key * 0x9E3779B97F4A7C15 + 1) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def numbered(docs: DataFrame) -> DataFrame:
    """(key, source, doc_id, tie, size, start, source_size): start is the words before a document in its source."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    slim = docs.select(key.alias("key"), "source", "doc_id", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    slim = materialize(slim, "mix-sizes")
    buckets = max(BUCKETS, math.ceil(slim.count() / PER_BUCKET))
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(buckets)))
    sums = slim.groupBy("key", "bucket").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "key", "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"), F.sum("own").over(Window.partitionBy("key")).alias("source_size")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(sums, ["key", "bucket"]).select(
        "key", "source", "doc_id", "tie", "size", (F.col("inner") + F.col("base")).alias("start"), "source_size"
    )


def sources_of(placed: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple]:
    """(no, key, target, block, blocks, slots) of each source, in code point order, null last."""
    rows = placed.groupBy("key", "source").agg(F.max("source_size").alias("size")).collect()
    named = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    out = []
    for no, (r, goal) in enumerate(zip(named, targets([int(r.size) for r in named], weights, share, most), strict=True)):
        block = min(LONGEST, max(SHORTEST, r.size // BLOCKS))
        blocks = -(-r.size // block)
        out.append((no, r.key, goal, block, blocks, min(round(goal / r.size * blocks), math.floor(most * blocks)) if r.size else 0))
    return out


def slots_of(spark: SparkSession, sources: list[tuple], seed: int = SEED) -> DataFrame:
    """(no, shard, slot, block_no) of every slot of the mix, its block by the permuted index."""
    rows, base = [], [0] * len(sources)
    for shard, own in enumerate(shard_counts([s[5] for s in sources], seed) if sum(s[5] for s in sources) else []):
        for (no, _, _, _, blocks, _), n in zip(sources, own, strict=True):
            if n:
                rows.append((no, shard, base[no], n, blocks))
                base[no] += n
    drawn = spark.createDataFrame(rows, "no int, shard int, first long, n long, blocks long").repartition("no", "shard")

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for first in range(row["first"], row["first"] + row["n"], 1 << 16):
                    slot = np.arange(first, min(first + (1 << 16), row["first"] + row["n"]))
                    block = np.empty_like(slot)
                    for turn in np.unique(slot // row["blocks"]):
                        of = slot // row["blocks"] == turn
                        block[of] = permute(slot[of] % row["blocks"], row["blocks"], seed + 1000 * row["no"] + 7 * int(turn))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), row["no"], np.int32)), pa.array(np.full(len(slot), row["shard"], np.int32)), pa.array(slot), pa.array(block)],
                        names=["no", "shard", "slot", "block_no"],
                    )

    return drawn.mapInArrow(place, "no int, shard int, slot long, block_no long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of docs (doc_id, source, text).

    documents: key, source, doc_id, tie, size, start, source_size, target, block. pieces: shard, slot, doc_id,
    key, start (of the document), first (word of the document, from 0), words; a block's pieces share its slot.
    """
    spark = docs.sparkSession
    placed = materialize(numbered(docs), "mix-order")
    sources = sources_of(placed, weights, share, most)
    named = spark.createDataFrame([s[:4] for s in sources], "no int, key string, target double, block long")
    placed = placed.join(named, "key")
    cut = placed.where("size > 0").select(
        "no", "key", "doc_id", "tie", "source", "start", "size", "block",
        F.explode(F.sequence(F.expr("start div block"), F.expr("(start + size - 1) div block"))).alias("block_no"),
    )
    first = F.greatest(F.lit(0), F.col("block_no") * F.col("block") - F.col("start"))
    words = F.least(F.col("size"), (F.col("block_no") + 1) * F.col("block") - F.col("start")) - first
    cut = cut.select("no", "block_no", "key", "source", "doc_id", "tie", "start", first.alias("first"), words.alias("words"))
    return placed, slots_of(spark, sources, seed).join(cut, ["no", "block_no"]).drop("no", "block_no")


def mixed_shards(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, source, doc_id, start, first, words, text) of the mix of docs (doc_id, source, text): what each output shard holds.

    A shard is its rows by slot, source and start + first, the place in the source; text is the run of words from the word `first` on.
    """
    _, pieces = mix(docs, **options)
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select(key.alias("key"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_tie"), "text").dropDuplicates(["key", "own_id", "own_tie"])
    both = pieces.join(rows, (pieces["key"] == rows["key"]) & pieces["doc_id"].eqNullSafe(rows["own_id"]) & (pieces["tie"] == rows["own_tie"]))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
    return both.select("shard", "slot", "source", "doc_id", "start", "first", "words", F.array_join(words, "").alias("text"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, same columns; text is what it takes, repeats after it.

    A document taken whole keeps its text; runs of words keep the white space between them.
    """
    own = docs.columns
    _, pieces = mix(docs)
    piece = pieces.groupBy("key", "source", "doc_id", "tie", "start", "first", "words").agg(F.count("*").alias("times"))
    takes = piece.groupBy("key", "doc_id", "tie", "start").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("takes"))
    takes = takes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "key", "tie").orderBy("start"))).drop("start")
    key_, tie_, copy_, takes_, words_ = (fresh(own, n) for n in ("_key", "_tie", "_copy", "_takes", "_words"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.withColumn(key_, key).withColumn(tie_, F.xxhash64("text"))
    rows = rows.withColumn(copy_, F.row_number().over(Window.partitionBy("doc_id", key_, tie_).orderBy(F.xxhash64(*[f"`{c}`" for c in own]))))
    both = rows.alias("d").join(takes.alias("t"), F.expr(f"d.doc_id <=> t.doc_id and d.{key_} = t.key and d.{tie_} = t.tie and d.{copy_} = t.copy"))
    both = both.select(*[f"d.`{c}`" for c in own], F.col("t.takes").alias(takes_), F.regexp_extract_all(F.col("d.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)).alias(words_))

    def turn(times: Column) -> Column:
        run = F.transform(F.filter(takes_, lambda t: t["times"] >= times), lambda t: F.array_join(F.slice(words_, (t["first"] + 1).cast("int"), t["words"].cast("int")), ""))
        return F.array_join(run, "")

    times = F.sequence(F.lit(1).cast("bigint"), F.array_max(F.transform(takes_, lambda t: t["times"])))
    text = F.array_join(F.transform(times, turn), "\n")
    once = F.aggregate(takes_, F.lit(0).cast("bigint"), lambda a, t: a + t["words"]) == F.size(words_)
    whole = once & F.forall(takes_, lambda t: t["times"] == 1)
    out = both.withColumn("text", F.when(whole, F.col("text")).otherwise(text))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*own)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = pieces.groupBy("key", "start").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    whole = placed.join(taken.withColumn("some", F.lit(True)), (placed["key"] == taken["key"]) & (placed["start"] == taken["start"]) & (placed["size"] > 0), "left")
    return whole.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_shard", "last_shard")
