"""Keyword lookup, vector search and their hybrid ranking, for many queries at once.

Every plan takes queries as rows, so one query and a million are the same plan: postings meet query tokens in an equi-join
by (collection, token), and every top-k is a window per query or, for one query, a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EngineConfig
from ..functions import tokens as K

#: Queries that are broadcast, and parts of a collection's vectors beyond that.
FEW_QUERIES, SALTS = 1000, 64


def postings(chunks: DataFrame) -> DataFrame:
    """(collection, chunk_id, token, tf) of chunks (collection, id, content)."""
    return K.postings(chunks.select("collection", F.col("id").alias("chunk_id"), "content"))


def replace_postings(old: DataFrame, chunks: DataFrame) -> DataFrame:
    """Postings after (re)indexing chunks: theirs replace what the same ids had."""
    ids = chunks.select("collection", F.col("id").alias("chunk_id")).distinct()
    return old.join(ids, ["collection", "chunk_id"], "left_anti").unionByName(postings(chunks))


def remove_postings(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("collection", "chunk_id").distinct(), ["collection", "chunk_id"], "left_anti")


def postings_stats(post: DataFrame) -> DataFrame:
    """Chunks, tokens and occurrences by collection."""
    tokens = post.groupBy("collection", "token").agg(F.sum("tf").alias("tf")).groupBy("collection").agg(F.count("*").alias("n_tokens"), F.sum("tf").alias("n_occurrences"))
    chunks = post.select("collection", "chunk_id").distinct().groupBy("collection").agg(F.count("*").alias("n_chunks"))
    return chunks.join(tokens, "collection").select("collection", "n_chunks", "n_tokens", "n_occurrences")


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, collection, token): the distinct tokens of queries (query_id, collection, query)."""
    return queries.select("query_id", "collection", F.explode(F.array_distinct(K.tokens(F.col("query")))).alias("token"))


def keyword_lookup(queries: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tf): occurrences of a query's tokens in each chunk; queries without tokens find nothing."""
    return query_tokens(queries).join(post, ["collection", "token"]).groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("tf"))


def pruned(post: DataFrame, queries: DataFrame, most: int = 500) -> DataFrame:
    """post, with a filter on the tokens that reaches the scan where queries have at most `most` of them."""
    wanted = query_tokens(queries).select("token").distinct().limit(most + 1).collect()
    return post.where(F.col("token").isin([r.token for r in wanted])) if len(wanted) <= most else post


def keyword_scan(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """As keyword_lookup, from chunks (collection, id, content) without postings: only tokens that some query has are counted and moved."""
    rows = K.token_rows(chunks.select("collection", F.col("id").alias("chunk_id"), "content"))
    return query_tokens(queries).join(rows, ["collection", "token"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("tf"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def valid_vector(vector: Column, dim: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """rows, failing at run time where a vector is missing, of another length or not finite."""
    bad = F.raise_error(F.concat(F.lit(f"not a vector of {dim} numbers: "), F.coalesce(F.to_json("vector"), F.lit("null"))))
    return rows.withColumn("vector", F.when(valid_vector(F.col("vector"), dim), F.col("vector")).otherwise(bad.cast("array<float>")))


def ranked(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each query_id with their rank from 1."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", n).where(F.col("rank") <= k)


def vector_hits(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, cos): the nearest chunks (collection, id, vector) of queries (query_id, collection, query_vector).

    Queries meet the chunks of their collection only, by an equi-join; each query's norm is computed once. Up to FEW_QUERIES queries go to
    the vectors, which stay where they are; more of them are dealt to SALTS parts of each collection's vectors, so that no
    collection is a single task.
    """
    q = queries.select("query_id", "collection", "query_vector", F.sqrt(dot(F.col("query_vector"), F.col("query_vector"))).alias("qn"))
    c = chunks.select("collection", F.col("id").alias("chunk_id"), "vector", F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("cn"))
    scale = F.col("qn") * F.col("cn")
    score = F.when(scale > 0, dot(F.col("query_vector"), F.col("vector")) / scale).otherwise(0.0)
    if q.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        pairs = F.broadcast(q).join(c, "collection")
    else:
        dealt = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = dealt.join(c.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")), ["collection", "part"])
    return ranked(pairs.select("query_id", "chunk_id", score.alias("cos")), limit, F.desc("cos"), "chunk_id").drop("rank")


def fitted_centres(chunks: DataFrame, cells: int = 128, sample: int = 20_000, rounds: int = 8) -> list[list[float]]:
    """Centres of an inverted file by spherical k-means, on the `sample` vectors of smallest hash of chunks (vector)."""
    import numpy as np

    rows = chunks.select("vector").where(F.col("vector").isNotNull()).orderBy(F.xxhash64("vector"), "vector").limit(sample).toPandas()["vector"]
    if rows.empty:
        return []
    x = np.stack(rows.to_numpy()).astype(float)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres.tolist()


def clustered_hits(queries: DataFrame, chunks: DataFrame, limit: int, centres: list[list[float]], probes: int = 16) -> DataFrame:
    """As vector_hits, but each query looks only into the chunks of its `probes` nearest centres (an inverted file).

    centres is a bounded list, at most a few thousand. Fewer probes than centres make the search approximate.
    """
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    order = lambda v: F.transform(
        F.array_sort(F.transform(table, lambda c, i: F.struct((-cosine(v, c)).alias("far"), i.alias("cell")))), lambda s: s["cell"]
    )
    own = chunks.withColumn("cell", F.element_at(order(F.col("vector")), 1))
    asked = queries.withColumn("cell", F.explode(F.slice(order(F.col("query_vector")), 1, probes)))
    pairs = asked.join(own, ["collection", "cell"])
    scored = pairs.select("query_id", F.col("id").alias("chunk_id"), cosine(F.col("query_vector"), F.col("vector")).alias("cos"))
    return ranked(scored, limit, F.desc("cos"), "chunk_id").drop("rank")


def boosted(cos: Column, tf: Column, config: EngineConfig = EngineConfig()) -> Column:
    return cos + F.least(F.lit(config.hit_boost) * F.coalesce(tf, F.lit(0)), F.lit(config.hit_boost_cap))


def keyword_score(tf: Column, config: EngineConfig = EngineConfig()) -> Column:
    return F.least(F.lit(config.keyword_base) + F.lit(config.keyword_step) * tf, F.lit(config.keyword_cap))


def keyword_only(found: DataFrame, hits: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, chunk_id, score, tf) of the keyword matches that no vector hit covers, the most frequent first."""
    rest = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = ranked(rest, config.keyword_only_limit, F.desc("tf"), "chunk_id")
    return best.select("query_id", "chunk_id", keyword_score(F.col("tf"), config).alias("score"), "tf")


def hybrid(queries: DataFrame, chunks: DataFrame, post: DataFrame, top_k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, rank, chunk_id, score, relative_path, start_line, end_line, language, content).

    queries: query_id, collection, query, query_vector. Vector hits get a bounded boost by keyword occurrences, other keyword
    matches a bounded score of their own; ties go to the smaller chunk id. Only the final rows meet contents.
    """
    hits = vector_hits(queries, chunks, config.recall(top_k))
    return hybrid_of(queries, chunks, hits, keyword_lookup(queries, post), top_k, config)


def hybrid_of(queries: DataFrame, chunks: DataFrame, hits: DataFrame, found: DataFrame, top_k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The ranking of hybrid() from vector hits (query_id, chunk_id, cos) and keyword matches (query_id, chunk_id, tf)."""
    both = hits.join(found, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", boosted(F.col("cos"), F.col("tf"), config).alias("score"))
    pool = both.unionByName(keyword_only(found, hits, config).select("query_id", "chunk_id", "score"))
    # What is found in postings or vectors is stored as a chunk, so the ranking needs no chunk.
    best = ranked(pool, top_k, F.desc("score"), "chunk_id").join(queries.select("query_id", "collection"), "query_id")
    known = chunks.select("collection", F.col("id").alias("chunk_id"), "relative_path", "start_line", "end_line", "language", "content")
    rows = best.join(known, ["collection", "chunk_id"])
    return rows.select("query_id", "rank", "chunk_id", "score", "relative_path", "start_line", "end_line", "language", "content")
