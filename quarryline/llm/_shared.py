"""What several operators need: shared storage, components, Arrow word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a hot key are spread over so many tasks; a hot key has more than HOT_ROWS rows, and HOT_KEYS are sought at most.
SALTS, HOT_ROWS, HOT_KEYS = 32, 250, 1000
#: Edges that one task contracts.
EDGES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode, where all tasks share a disk, a temporary one stands in where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh(columns: list[str], name: str) -> str:
    """name, or name with as many underscores more as it takes to be none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what materialize wrote, when nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key; keys with very many rows of left are spread over SALTS tasks.

    At most HOT_KEYS keys are treated so, those with most rows; any other key then has less than a HOT_KEYS-th of left.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    top = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(key)
    rows = top.collect()
    if not rows:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, top.schema).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    some = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    many = right.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return some.join(many, [key, "_salt"], how).drop("_salt")


def attached(left: DataFrame, right: DataFrame, key: str, few: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key: at most `few` rows of right are broadcast, more are looked up with hot keys salted."""
    if right.count() <= few:
        return left.join(F.broadcast(right), key, how)
    return salted_lookup(left, right, key, how)


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the nodes of edges u, v that reach a smaller one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _local_forest(batches):
    """Edges of one task -> (node, smallest node it reaches by them)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
    node, low = contracted(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["u", "v"])


def connected_components(edges: DataFrame, name: str = "cc", per_task: int = EDGES) -> DataFrame:
    """(u, v) long edges -> (node, component): the smallest node reachable, for every node that has an edge.

    Each round contracts the edges of every task, about per_task of them, to stars and then takes a large-star
    and a small-star step across tasks; edges of a single task are done after contraction. Each state is
    written to the shared folder, so no step depends on the memory of an executor. Self loops
    and repeated edges are allowed, an empty table gives an empty result.
    """
    state = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
    before = None
    while True:
        count, check = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == 0 or (count, check) == before:
            break
        before = (count, check)
        tasks = -(-count // per_task)
        stars = materialize(state.repartition(tasks).mapInArrow(_local_forest, "u long, v long"), name)
        forget(state)
        state = stars
        if tasks == 1:
            break
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_lookup(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = salted_lookup(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(near.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(state)
        forget(large)
        state = after
    children = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.union(state.select("v", "v").distinct())
