"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= 0.95 means a distance of at most sqrt(2 - 1.9). Equal
vectors, told by 128 bits of hash, are joined first. A cover tree over a bounded sample gives cells, every vector going
to its nearest centre; the cells' measured covering radii prune pairs of cells, each row finding its own partners from the
bounded list of centres. Cells are cut into blocks of bounded rows and bytes, whose cover trees, nested levels with halving radii, are
built once; each pair of blocks is a task that traverses two trees at once. A pair of nodes is dropped when its centres
are further apart than the threshold and both radii, counted whole when centres and radii stay within it, and else opened; single
vectors are compared in double precision. Tasks give link counts and a spanning forest of the links, never the pairs.

The first radius is the one of the halving series whose first level leaves least to do on the sample: bounds use measured
radii, so it changes the work and never the result.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
do vectors of different lengths; repeated rows are rows of their own that link; an empty table gives an empty result.
A null vec_id takes part and never names a component unless nothing else can. Only the columns vec_id and vector are read, so others
may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import connected_components, contracted, forget, materialize, salted_lookup, table

COSINE = 0.95
#: Vectors of the sample that the upper tree is built on; vectors of a block at most on average, and bytes of them in double precision.
SAMPLE, BLOCK, BLOCK_BYTES = 4096, 16_384, 16 << 20
#: Radii of a block's levels, from the chosen one on; bounds computed in single precision are widened by SLACK.
RADII, SLACK = (1.0, 0.5, 0.25, 0.125), 1e-5
#: Vectors of the sample that the first radius is chosen on, what a pair of rows costs there beside one of nodes, and edges kept before they are contracted.
TRIED, OPENED, EDGES = 1024, 10, 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: it has components, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of a and b in double precision; rows have length one."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def net(x: np.ndarray, radius: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are centres, centre number of every row): no centre within radius of an earlier one, rows at their nearest."""
    y = x.astype(np.float32)
    far = 1.0 - radius * radius / 2
    centres: list[int] = []
    for a in range(0, len(y), batch):
        part = y[a : a + batch]
        free = np.ones(len(part), bool)
        for c in range(0, len(centres), 4096):
            free &= (part @ y[centres[c : c + 4096]].T).max(axis=1) < far
        rest = np.flatnonzero(free)
        inner = part[rest] @ part[rest].T >= far
        alive = np.ones(len(rest), bool)
        for i in range(len(rest)):
            if alive[i]:
                centres.append(a + int(rest[i]))
                alive[i:] &= ~inner[i, i:]
    best, of = np.full(len(y), -np.inf, np.float32), np.zeros(len(y), np.int64)
    for c in range(0, len(centres), 2048):
        dots = y @ y[centres[c : c + 2048]].T
        at = dots.argmax(axis=1)
        top = dots[np.arange(len(y)), at]
        better = top > best
        best[better], of[better] = top[better], c + at[better]
    of[centres] = np.arange(len(centres))
    return np.array(centres, np.int64), of


def levels_of(x: np.ndarray, radii: tuple[float, ...] = RADII) -> tuple[np.ndarray, np.ndarray]:
    """(node of every row, whether the row is its centre) by level; a node's children have successive numbers."""
    parents = np.zeros(len(x), np.int64)
    labels, leads = np.zeros((len(x), len(radii)), np.int32), np.zeros((len(x), len(radii)), bool)
    for k, radius in enumerate(radii):
        count = 0
        order = np.argsort(parents, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(parents[order]) > 0))
        for rows in np.split(order, cuts[1:]):
            if len(rows) == 1:
                labels[rows, k], leads[rows, k] = count, True
                count += 1
                continue
            c, of = net(x[rows], radius)
            labels[rows, k] = count + of
            leads[rows[c], k] = True
            count += len(c)
        parents = labels[:, k].astype(np.int64)
    return labels, leads


class Tree:
    """Levels of nodes over rows of x: rows are ordered so that every node holds a range of them."""

    def __init__(self, x: np.ndarray, labels: np.ndarray | None = None, leads: np.ndarray | None = None):
        if labels is None or leads is None:
            labels, leads = levels_of(x)
        # Children of a node have numbers after each other, so ordering by the last level orders by all.
        self.order = np.argsort(labels[:, -1], kind="stable")
        self.x = x[self.order]
        self.levels = []
        for k in range(labels.shape[1]):
            own = labels[self.order, k]
            begin = np.flatnonzero(np.append(True, np.diff(own) > 0))
            end = np.append(begin[1:], len(own))
            rows = np.flatnonzero(leads[:, k])
            centre = x[rows[np.argsort(labels[rows, k])]]
            gap = 1.0 - np.clip(cosines(self.x, np.repeat(centre, end - begin, axis=0)), -1, 1)
            radius = np.sqrt(2 * np.maximum.reduceat(gap, begin))
            self.levels.append((centre, np.where(end - begin == 1, 0.0, radius + 1e-7), begin, end))
        n = len(x)
        self.levels.append((self.x, np.zeros(n), np.arange(n), np.arange(n) + 1))


def dual(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(links of every row of a, of b, forest edges as two arrays of rows, b's after a's), rows in the trees' order.

    With same, a and b are one tree: each row is not compared with itself, and only a's counts are given.
    """
    reach = math.sqrt(2 - 2 * cosine)
    na, nb = len(a.x), len(b.x)
    add_a, add_b, own_too = np.zeros(na + 1), np.zeros(nb + 1), np.zeros(na + 1)
    sum_a, sum_b = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weight_a, weight_b))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    off = 0 if same else na

    def whole(i: np.ndarray, j: np.ndarray, la, lb) -> None:
        """Counts node pairs whose rows all link; the rows of both hang on the first row of the first."""
        (_, _, ba, ea), (_, _, bb, eb) = la, lb
        for add, own, begin, end, other in ((add_a, i, ba, ea, (sum_b, bb[j], eb[j])), (add_b, j, bb, eb, (sum_a, ba[i], ea[i]))):
            value = other[0][other[2]] - other[0][other[1]]
            np.add.at(add, begin[own], value)
            np.add.at(add, end[own], -value)
        if same:  # a node counted whole with itself counts each row with itself
            np.add.at(own_too, ba[i[i == j]], 1)
            np.add.at(own_too, ea[i[i == j]], -1)
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if ea[p] - ba[p] > 1 or eb[q] - bb[q] > 1:
                rows = np.concatenate([np.arange(ba[p], ea[p]), np.arange(bb[q], eb[q]) + off])
                rows = rows[rows != ba[p]]
                edges.append((np.full(len(rows), ba[p]), rows))
        single = (ea[i] - ba[i] == 1) & (eb[j] - bb[j] == 1)
        edges.append((ba[i[single]], bb[j[single]] + off))
        if sum(len(e[0]) for e in edges) > EDGES:
            edges[:] = [_forest(edges)]

    def judge(i: np.ndarray, j: np.ndarray, level: int):
        """The pairs of nodes of a level that are neither dropped nor counted."""
        la, lb = a.levels[level], b.levels[level]
        (ca, ra, ba, ea), (cb, rb, bb, eb) = la, lb
        keep_i, keep_j = [i[:0]], [j[:0]]
        for s in range(0, len(i), 1 << 15):
            p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            cos = cosines(ca[p], cb[q])
            d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
            both = ra[p] + rb[q]
            single = (ra[p] == 0) & (rb[q] == 0) & (ea[p] - ba[p] == 1) & (eb[q] - bb[q] == 1)
            inside = np.where(single, cos >= cosine, d + both <= reach - 1e-6)
            if same:
                inside &= ~(single & (ba[p] == bb[q]))
            if inside.any():
                whole(p[inside], q[inside], la, lb)
            open_ = ~inside & ~single & (d <= reach + both + 1e-6)
            keep_i.append(p[open_])
            keep_j.append(q[open_])
        return np.concatenate(keep_i), np.concatenate(keep_j)

    # First level: all pairs of nodes, in tiles, single precision with slack. Nodes of one vector come first: their tiles share one bound.
    (ca, ra, _, _), (cb, rb, _, _) = a.levels[0], b.levels[0]
    pa_, pb_ = np.argsort(ra, kind="stable"), np.argsort(rb, kind="stable")
    fa, fb, ra, rb = ca[pa_].astype(np.float32), cb[pb_].astype(np.float32), ra[pa_].astype(np.float32), rb[pb_].astype(np.float32)
    open_i, open_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(fa), 1024):
        for t in range(0, len(fb), 1024):
            qa, qb = ra[s : s + 1024], rb[t : t + 1024]
            bound = np.float32(reach) if not (qa.any() or qb.any()) else (reach + qa)[:, None] + qb[None, :]
            i, j = np.nonzero(fa[s : s + 1024] @ fb[t : t + 1024].T >= 1 - bound * bound / 2 - np.float32(SLACK))
            open_i.append(pa_[s + i])
            open_j.append(pb_[t + j])
    i, j = judge(np.concatenate(open_i), np.concatenate(open_j), 0)
    for level in range(1, len(a.levels)):
        if not len(i):
            break
        i, j = _children(a, b, level, i, j)
        i, j = judge(i, j, level)
    return np.cumsum(add_a)[:-1] - np.cumsum(own_too)[:-1] * weight_a, np.cumsum(add_b)[:-1], _forest(edges)


def _forest(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row it reaches) for what the edges connect."""
    u, v = (np.concatenate([np.empty(0, np.int64), *[e[k] for e in edges]]).astype(np.int64) for k in (0, 1))
    return contracted(u, v)


def _children(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children, at a level, of pairs of nodes of the level above."""
    spans = []
    for tree, own in ((a, i), (b, j)):
        begin, child = tree.levels[level - 1], tree.levels[level]
        spans.append((np.searchsorted(child[2], begin[2][own]), np.searchsorted(child[2], begin[3][own])))
    (a0, a1), (b0, b1) = spans
    count = (a1 - a0) * (b1 - b0)
    of = np.repeat(np.arange(len(i)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    width = (b1 - b0)[of]
    return a0[of] + k // width, b0[of] + k % width


def first_radius(x: np.ndarray, cosine: float, radii: tuple[float, ...] = RADII) -> int:
    """Number of the radius whose nodes leave the fewest comparisons between rows of x: pairs of nodes, and rows of those that stay open."""
    reach, best = math.sqrt(2 - 2 * cosine), (math.inf, 0)
    for k in range(len(radii)):
        tree = Tree(x, *levels_of(x, radii[k : k + 1]))
        centre, radius, begin, end = tree.levels[0]
        d = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T)))
        open_ = (d <= reach + radius[:, None] + radius[None, :]) & (radius[:, None] + radius[None, :] > 0)
        size = (end - begin).astype(float)
        best = min(best, (len(centre) ** 2 + OPENED * float(size @ open_ @ size), k))
    return best[1]


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    own = column.combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def _leveled(radii: dict[int, tuple[float, ...]]):
    """Adds to a block's rows their nodes in its cover tree."""

    def run(block: pa.Table) -> pa.Table:
        x = unit(_rows(block["vector"]).astype(np.float64))
        labels, leads = levels_of(x, radii.get(x.shape[1], RADII))
        ends = np.arange(len(x) + 1, dtype=np.int32) * labels.shape[1]
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel())) for v in (labels, leads)]
        return block.append_column("labels", lists[0]).append_column("leads", lists[1])

    return run


def _compared(cosine: float):
    """Of the rows (rep, weight, vector, labels, leads, block, one, two): links by rep, and forest edges (rep, other)."""

    def run(pair: pa.Table) -> pa.Table:
        one, two = pair["one"][0].as_py(), pair["two"][0].as_py()
        block, rep, weight = (pair[c].to_numpy() for c in ("block", "rep", "weight"))
        order = np.lexsort((rep, block))
        sides = [order[block[order] == k] for k in ([one] if one == two else [one, two])]
        kinds = [("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]
        if any(not len(s) for s in sides):
            return pa.Table.from_arrays([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
        x, labels, leads = (_rows(pair[c]) for c in ("vector", "labels", "leads"))
        trees = [Tree(unit(x[s].astype(np.float64)), labels[s], leads[s].astype(bool)) for s in sides]
        ids = [rep[s][t.order] for s, t in zip(sides, trees, strict=True)]
        weights = [weight[s][t.order].astype(float) for s, t in zip(sides, trees, strict=True)]
        got_a, got_b, (u, v) = dual(trees[0], trees[-1], weights[0], weights[-1], one == two, cosine)
        rows = np.concatenate(ids)
        links = np.round(got_a if one == two else np.concatenate([got_a, got_b])).astype(np.int64)
        some = np.flatnonzero(links > 0)
        none = pa.nulls(len(some), pa.int64())
        out = [
            pa.concat_arrays([pa.array(rows[some]), pa.array(rows[u])]),
            pa.concat_arrays([pa.array(links[some]), pa.array(np.zeros(len(u), np.int64))]),
            pa.concat_arrays([none, pa.array(rows[v])]),
        ]
        return pa.Table.from_arrays(out, names=[n for n, _ in kinds])

    return run


def block_rows(dim: int, block: int = BLOCK) -> int:
    return max(1, min(block, BLOCK_BYTES // (8 * max(1, dim))))


def cells(vectors: DataFrame, n: int, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> tuple[dict[int, np.ndarray], dict[int, tuple[float, ...]]]:
    """(centres of the cells, radii of the trees) by dimension, from the vectors of smallest hash."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()["vector"].combine_chunks()
    dims = rows.value_lengths().to_numpy()
    out, radii = {}, {}
    for dim in np.unique(dims).tolist():
        x = unit(_rows(pa.chunked_array([rows.filter(pa.array(dims == dim))])).astype(np.float64))
        want, radius = min(sample, math.ceil(n / block_rows(dim, block))), 1.4
        while True:
            found, _ = net(x, radius)
            if len(found) >= min(want, len(x)) or radius < 1e-3:
                break
            radius *= 0.9
        out[dim] = x[found[:want]]
        radii[dim] = RADII[first_radius(x[:TRIED], cosine) :]
    return out, radii


def _first_cells(centres: dict[int, np.ndarray]) -> dict[int, int]:
    """Number of the first cell of each dimension."""
    return {d: sum(len(centres[e]) for e in centres if e < d) for d in centres}


def _assigned(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """vectors with cell and the distance to its centre."""
    base, own = _first_cells(centres), vectors.columns
    at = own.index("vector")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            dims = column.value_lengths().to_numpy()
            cell, gap = np.full(len(dims), -1, np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                # Vectors of a length that the sample has not seen share a cell by length.
                of = dims == d
                if d not in centres:
                    cell[of], gap[of] = -1 - d, 2.0
                    continue
                x = unit(_rows(pa.chunked_array([column.filter(pa.array(of))])).astype(np.float64))
                cos = x @ centres[d].T
                cell[of] = base[d] + cos.argmax(axis=1)
                gap[of] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*own, "cell", "gap"])

    return vectors.mapInArrow(run, vectors.select("*").schema.add("cell", "long").add("gap", "double"))


def _near(cell: int, centres: dict[int, np.ndarray], radii: dict[int, float], reach: float) -> list[int]:
    """The cells that can hold a link to a cell's rows, by covering radii; cells of unseen lengths meet only themselves."""
    if cell < 0:
        return [cell]
    base = _first_cells(centres)
    dim = next(d for d in sorted(base, reverse=True) if base[d] <= cell)
    own = np.array([c for c in range(base[dim], base[dim] + len(centres[dim])) if c in radii], np.int64)
    d = np.sqrt(np.maximum(0, 2 - 2 * (centres[dim][own - base[dim]] @ centres[dim][cell - base[dim]])))
    return own[d <= reach + radii[cell] + np.array([radii[c] for c in own.tolist()]) + 1e-6].tolist()


def _spread(blocks: DataFrame, centres: dict[int, np.ndarray], radii: dict[int, float], first: dict[int, int], parts: dict[int, int], reach: float) -> DataFrame:
    """Every row of blocks once for each pair of blocks it is in, with the pair's numbers (one, two)."""
    own = blocks.columns
    at = [own.index(c) for c in ("cell", "block")]

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, block = (batch.column(i).to_numpy() for i in at)
            for c in np.unique(cell).tolist():
                if c not in known:
                    known[c] = np.concatenate([first[o] + np.arange(parts[o]) for o in _near(c, centres, radii, reach)])
                rows = np.flatnonzero(cell == c)
                part = batch.take(pa.array(rows))
                for other in known[c]:
                    one, two = np.minimum(block[rows], other), np.maximum(block[rows], other)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(one), pa.array(two)], names=[*own, "one", "two"])

    return blocks.mapInArrow(run, blocks.select("*").schema.add("one", "long").add("two", "long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, vector)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("vector")), F.col("vector")).alias("vector"))
    rows = rows.withColumn("same", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector", F.lit(1)).alias("a"), F.xxhash64("vector", F.lit(2)).alias("b"))))
    good = rows.where("vector is not null")
    reps = good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    # Without an id a vector stands for itself under a number below all ids.
    reps = materialize(reps.withColumn("rep", F.coalesce("rep", F.col("same.a").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(-(2**63))))), "cover-vectors")
    n = reps.count()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n == 0:
        return alone
    centres, levels = cells(reps, n, cosine, block=block)
    placed = materialize(_assigned(reps, centres), "cover-cells")
    # At most SAMPLE cells, whatever the input, and one for each length of vectors that the sample lacks.
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.max(F.size("vector")).alias("dim")).collect()
    radii = {r.cell: r.radius for r in stats}
    parts = {r.cell: math.ceil(r.n / block_rows(r.dim, block)) for r in sorted(stats)}
    first, at = {}, 0
    for c, k in parts.items():
        first[c], at = at, at + k
    own = spark.createDataFrame([(c, first[c], k) for c, k in parts.items()], "cell long, first long, parts long")
    # Rows of a large cell are dealt to its blocks by hash. A block's tree is built once.
    dealt = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")
    blocks = placed.join(F.broadcast(own), "cell").select("cell", "rep", "weight", "vector", dealt)
    kinds = blocks.select("*").schema.add("labels", T.ArrayType(T.IntegerType())).add("leads", T.ArrayType(T.BooleanType()))
    blocks = materialize(blocks.groupBy("block").applyInArrow(_leveled(levels), kinds), "cover-blocks")
    spread = _spread(blocks, centres, radii, first, parts, math.sqrt(2 - 2 * cosine)).drop("cell")
    found = materialize(spread.groupBy("one", "two").applyInArrow(_compared(cosine), "rep long, links long, other long"), "cover-links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")), "cover-components")
    # A component's smallest id: representatives are the smallest of their copies; numbers of vectors without an id are skipped.
    named = joined.where("node >= -4611686018427387904").groupBy("component").agg(F.min("node").alias("component_id"))
    joined = salted_lookup(joined.select(F.col("node").alias("rep"), "component"), named, "component", "left").select("rep", "component_id")
    summed = reps.select("same", "rep", "weight").join(links, "rep", "left").join(joined, "rep", "left")
    summed = materialize(
        summed.select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", F.when(F.col("rep") >= -(2**62), F.col("rep"))).alias("component_id")),
        "cover-sums",
    )
    for done in (reps, placed, blocks, found):
        forget(done)
    of_good = salted_lookup(good.select("vec_id", "same"), summed, "same").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    return of_good.unionByName(rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
