"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs after several learned rotations (iterative quantisation, alternating codes
and orthogonal Procrustes fits on a bounded sample). A block of rows indexes each of the codes' eight-bit
substrings. By the pigeonhole principle a code within radius r of a query agrees with it up to r // m bits (the
last substrings one less) in one of m substrings, so probing those values in every substring retrieves every
code within r; their vectors are then ranked by exact distance in double precision.

The radius is the one that holds the share HOLD of the sample's true neighbours: among all rows neighbours are
nearer than among the sample, so recall only grows. A query that finds too few in a block takes the whole block. Rows and
queries are dealt into blocks of bounded size, and every pair of a row block and a query block is one task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do vectors
of another length than the query's; ties go to the smaller vec_id; repeated candidates are rows of their own, and a query's own id
is never a candidate; queries that repeat an id and a vector are one query, those that repeat an id alone have a ranking each; a null vec_id
takes no part; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import table
from .covertree import usable

NEAREST, BITS, SAMPLE, PROBES, HOLD, ROUNDS, SEED = 10, 256, 4096, 256, 0.98, 15, 29
#: Rows and queries of a block on average.
ROWS, QUERIES = 8192, 512
POP = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def rotations(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Columns of learned orthogonal rotations, bits of them in all; x is centred."""
    rng = np.random.default_rng(seed)
    d, out = x.shape[1], []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            codes = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ codes)
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to q in double precision."""
    gap = x - q
    return np.sqrt((gap * gap).sum(axis=1))


class Coder:
    """Codes of vectors of one length, learned from a sample, and the radius to search."""

    def __init__(self, sample: np.ndarray, nearest: int = NEAREST):
        scale = np.abs(sample).max() or 1.0
        self.mean, self.scale = (sample / scale).mean(axis=0), scale
        self.rotation = rotations(sample / scale - self.mean)
        codes = self.code(sample)
        need = []
        for i in range(min(PROBES, len(sample))):
            d = exact(sample[i], sample)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(nearest, len(sample) - 1)]
            need.append(POP[codes[near] ^ codes[i]].sum(axis=1, dtype=np.int64))
        need = np.concatenate(need) if need else np.zeros(0)
        self.radius = int(math.ceil(np.quantile(need, HOLD))) if len(need) else BITS

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x / self.scale - self.mean) @ self.rotation >= 0, axis=1)


class Index:
    """Rows of a block by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = np.stack([np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=256))]) for s in range(codes.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most radius bits."""
        m = self.codes.shape[1]
        base, extra = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for s in range(m):
            reach = base if s <= extra else base - 1
            if reach < 0:
                continue
            values = np.flatnonzero(POP[code[s] ^ np.arange(256, dtype=np.uint8)] <= reach)
            if len(values) == 256:
                seen[:] = True
                break
            for v in values.tolist():
                seen[self.order[self.starts[s, v] : self.starts[s, v + 1], s]] = True
            if seen.all():
                break
        rows = np.flatnonzero(seen)
        return rows[POP[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def _searcher(coders: dict[int, Coder], nearest: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            for dim, own in rows.groupby(rows["vector"].map(len)):
                asked = queries[queries["vector"].map(len) == dim]
                if asked.empty:
                    continue
                own = own.sort_values("vec_id", kind="stable")
                x, ids = np.stack(own["vector"].to_numpy()).astype(np.float64), own["vec_id"].to_numpy()
                coder = coders.get(int(dim))
                index = Index(coder.code(x)) if coder else None
                for q, same, vector in zip(asked["query_id"].tolist(), asked["same"].tolist(), asked["vector"], strict=True):
                    v = np.asarray(vector, np.float64)
                    found = index.within(coder.code(v[None])[0], coder.radius) if index else np.arange(len(x))
                    if (ids[found] != q).sum() < nearest:
                        found = np.arange(len(x))
                    found = found[ids[found] != q]
                    d = exact(v, x[found])
                    best = np.lexsort((ids[found], d))[:nearest]
                    out += [(q, same, int(i), float(s)) for i, s in zip(ids[found[best]], d[best], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "same", "vec_id", "score"]).astype({"query_id": "int64", "same": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest rows of vectors (vec_id, vector) to each of queries (query_id, vector)."""
    good = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    asked = queries.where(usable(F.col("vector")) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    asked = asked.withColumn("same", F.xxhash64("vector")).dropDuplicates(["query_id", "same"])
    sample = good.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).toPandas()["vector"]
    dims = sample.map(len)
    coders = {int(d): Coder(np.stack(sample[dims == d].to_numpy()).astype(np.float64), nearest) for d in sorted(dims.unique())}
    n_rows, n_asked = (max(1, math.ceil(f.count() / size)) for f, size in ((good, ROWS), (asked, QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = good.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).withColumn("query_block", each(n_asked))
    right = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(n_asked)).cast("int")).withColumn("row_block", each(n_rows))
    keys = ["row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searcher(coders, nearest), "query_id long, same long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "same").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))
