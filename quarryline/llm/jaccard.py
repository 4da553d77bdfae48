"""Exact similarity join on word shingles in the Jaccard metric: components of texts that link.

Two texts link when 100 * intersection >= percent * union of their sets of `words`-word shingles, that is, at a Jaccard
distance of at most 1 - percent / 100, the threshold. Texts with equal sets stand for one another.

Regions. Against pivots that are documents nearly every distance is close to 1, so windows of twice the threshold around a
nearest pivot would replicate every text into every region. The first pivots are therefore the universe
of shingles and its parts: the distance to the universe is a text's size, and its rings of sizes
are the first regions, a text near an outer boundary being replicated into the next ring. Within a ring
linked sets differ in at most T shingles, each of which touches one of the universe's parts (by hash). A text enters the
region of what it has in a part for every part that holds `rich` or more of its shingles, rich being the largest number
with more than T such parts: one of them is the same in a linked set, which enters that region too. Shingles that are common among all texts
are left out of this where the others still fill more than T parts, so that passages of many texts chain nothing; which
ones are common changes the work and never the result. Texts that share a region are chained into clusters, the only places
where links can be. Large clusters are chained once more, by pairs that share as many regions as linked sets must: all that enter
one but the T that may be touched.

Inside what is large still, pivots are documents: each text goes to the Voronoi region of its nearest pivot and is
replicated into those of earlier pivots that are at most twice the threshold further away, so by the triangle inequality every link
lies inside a region. Texts within the threshold of a pivot link to it at once; texts that such links connect are not
compared with each other any more, and a region of nothing else is done. Regions recurse until they are small; one that its pivots
don't cut to half of the comparisons is left whole, and its blocks of bounded documents and bytes meet in pairs, each a task that counts all
intersections by matrix product. Only forests of links leave a task.

Defined cases: null texts and texts without words have no shingles and link with nothing; repeated rows link; rows that share a
doc_id with other texts, or have none, are texts of their own; a null doc_id never names a component unless nothing else can; very long
texts are taken whole; empty tables give empty results; other columns are not read and may have any name. Shingles are told
by 64 bits of hash, sets by their size and 128 bits; rows without an id of their own are numbered by 62 bits of hash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import attached, connected_components, contracted, forget, fresh, materialize, salted_lookup, table
from ._words import in_slices, released

WORDS, PERCENT = 3, 90
#: Shingles that a region's part needs, at most.
INFORMED = 4
#: Documents and bytes of a block, and bytes of small clusters that share a task.
BLOCK, BLOCK_BYTES, SHARED_BYTES = 384, 4 << 20, 4 << 20
#: Pivots of a region, levels of regions at most, and share of the comparisons that a cut may leave.
PIVOTS, LEVELS, SHRINK = 8, 8, 0.5
#: Texts that hold a common shingle, at least, and how many common shingles are kept at most (4 bytes each).
COMMON, KNOWN = 20, 1_000_000
#: Shingles or keys that a task sends together, and those that one receives.
SENT, GROUPED = 1_000_000, 2_000_000
#: One of so many regions is met before the others.
SAMPLED = 16
#: Bytes of a region's key.
KEY_BYTES = 6
#: Texts of a region whose pairs are counted, at most.
PAIRED = 32
#: Ids of at most so many clustered documents are broadcast (8 bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows without an id of their own have numbers from OWN_IDS up to half of it.
OWN_IDS = -(2**63)
_U = np.uint64
#: The primes of xxh64, and the bytes of a block, of which shorter inputs have none.
XX = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
XX_BLOCK = 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """xxh64 of words: those shorter than its blocks all at once, by eight, four and single bytes."""
    import xxhash

    if not len(words):
        return np.empty(0, np.uint64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    at, size = ends[:-1].copy(), np.diff(ends)
    raw = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(8, np.uint8))
    eight, four = (np.ndarray(len(raw) - 7, t, raw, strides=(1,)) for t in (np.uint64, np.uint32))
    turned = lambda x, k: (x << _U(k)) | (x >> _U(64 - k))
    with np.errstate(over="ignore"):
        out = size.astype(np.uint64) + XX[4]
        for step in range(0, XX_BLOCK - 8, 8):
            some = np.flatnonzero((size >= step + 8) & (size < XX_BLOCK))
            own = turned(eight[at[some]] * XX[1], 31) * XX[0]
            out[some] = turned(out[some] ^ own, 27) * XX[0] + XX[3]
            at[some] += 8
        some = np.flatnonzero(size & 4)
        out[some] = turned(out[some] ^ four[at[some]].astype(np.uint64) * XX[0], 23) * XX[1] + XX[2]
        at[some] += 4
        for step in range(3):
            some = np.flatnonzero((size & 3) > step)
            out[some] = turned(out[some] ^ raw[at[some] + step].astype(np.uint64) * XX[4], 11) * XX[0]
        out = (out ^ (out >> _U(33))) * XX[1]
        out = (out ^ (out >> _U(29))) * XX[2]
        out ^= out >> _U(32)
    for i in np.flatnonzero(size >= XX_BLOCK).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[ends[i] : ends[i + 1]])
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    # White space is that of ASCII here: tab to carriage return, and the space.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.values.dictionary_encode()
    own = word_hashes(coded.dictionary)
    codes = coded.indices.to_numpy()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False).astype(bool)[codes] if len(codes) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()]
    w = own[codes[real]]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            h = mixed(h * _U(0x9E3779B97F4A7C15) + w[k : k + len(h)] + _U(1))
        out, a = [], 0
        for b in ends.tolist():
            n = b - a
            if n >= words:
                x = np.sort(h[a : b - words + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            elif n:
                one = np.full(1, n, np.uint64)
                for x in w[a:b]:
                    one = mixed(one * _U(0xD6E8FEB86659FD93) + x)
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
            a = b
    return out


def growth_of(percent: int) -> float:
    """Growth of the size rings: a text enters at most two rings or so."""
    return max(1.25, 100 / percent) if percent < 90 else 1.35


def share_of_rich(mean: float, rich: int) -> float:
    """Share of parts with at least `rich` shingles where the mean is so many."""
    return 1.0 - math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(rich))


def parts_of(least: int, differ: int) -> int:
    """Parts of a ring whose texts have `least` shingles or more: the most informed regions that leave more than `differ` of them."""
    need = differ + 1 + 3 * math.sqrt(differ + 1)
    for rich in range(INFORMED, 1, -1):
        for tenth in range(70, 9, -2):
            parts = max(1, round(10 * least / tenth))
            if parts * share_of_rich(least / parts, rich) >= need:
                return parts
    return differ + 1 + max(2, differ)


class Regions:
    """The region keys of shingle sets; common: sorted first halves of the hashes of shingles that are in many texts."""

    def __init__(self, percent: int = PERCENT, common: np.ndarray | None = None):
        self.percent, self.growth, self.edges, self.parts = percent, growth_of(percent), [1], {}
        self.common = np.empty(0, np.uint32) if common is None else common
        # Where the common ones with the same first bits start.
        self.shift = 32 - min(24, len(self.common).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.common >> np.uint32(self.shift), minlength=1 << (32 - self.shift)))]).astype(np.int32)

    def _grow(self, most: int) -> None:
        while self.edges[-1] <= most:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * self.growth)))

    def _part(self, ring: int) -> tuple[np.ndarray, int] | None:
        """(first hashes of the parts of a ring, shingles that linked sets differ in); none where only equal sets link."""
        if ring not in self.parts:
            self._grow(self.edges[ring])
            differ = 2 * (self.edges[ring + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            m = parts_of(self.edges[ring], differ)
            self.parts[ring] = (np.array([(j << 64) // m for j in range(m)], np.uint64), differ) if differ else None
        return self.parts[ring]

    def rare(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The shingles of every set that are not common."""
        flat = np.concatenate([np.empty(0, np.uint64), *sets])
        if not len(self.common) or not len(flat):
            return sets
        short = (flat >> _U(32)).astype(np.uint32)
        bits = short >> np.uint32(self.shift)
        at, end = self.starts[bits], self.starts[bits + np.uint32(1)]
        keep, some = np.ones(len(flat), bool), np.flatnonzero(at < end)
        while len(some):
            found = self.common[at[some]] == short[some]
            keep[some[found]] = False
            at[some] += 1
            some = some[~found & (at[some] < end[some])]
        return np.split(flat[keep], np.concatenate([[0], np.cumsum(keep)])[np.cumsum([len(s) for s in sets])][:-1])

    def keys(self, own: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        return self.spared(own, rare)[0]

    def spared(self, own: np.ndarray, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(keys, spare): a linked set has as many of the keys as the least spare of the keys that both have, or more."""
        n = len(own)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        self._grow(n * 100 // self.percent)
        first = int(np.searchsorted(self.edges, n, "right")) - 1
        last = int(np.searchsorted(self.edges, n * 100 // self.percent, "right")) - 1
        out: list[tuple[np.ndarray, int]] = []
        for ring in range(first, last + 1):
            found = self._part(ring)
            if found is None:
                continue
            # More than `differ` parts hold `rich` rare shingles or more, so one of them is untouched in a linked set. A text without so many
            # enters the regions of all its parts with rare shingles, where those that have them meet it, and regions by all shingles.
            part, differ = found
            rich = self._held(own if rare is None else rare, part, ring, differ, 0, out)
            if not rich:
                self._held(own, part, ring, differ, 1, out)
        keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *[k for k, _ in out]]), return_index=True)
        return keys.view(np.int64), np.repeat(np.array([x for _, x in out], np.int32), [len(k) for k, _ in out])[at]

    def _held(self, own: np.ndarray, part: np.ndarray, ring: int, differ: int, kind: int, out: list[tuple[np.ndarray, int]]) -> int:
        """Adds the keys of the parts that hold enough of own to out; what enough is, 0 where too few parts hold anything."""
        at = np.append(np.searchsorted(own, part), len(own))
        held = np.diff(at)
        rich = min(INFORMED, int(np.partition(held, len(held) - differ - 1)[len(held) - differ - 1]))
        # Where too few parts hold anything, all set shingles make the keys, and empty parts count too.
        some = np.flatnonzero(held >= (rich if rich or kind else 1))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own + _U(0x9E3779B97F4A7C15)))])
            sig = (total[at[1:]] - total[at[:-1]])[some]
            # At most `differ` of these parts are not the same in a linked set.
            out.append((mixed(mixed(sig) + mixed(some.astype(np.uint64) * _U(2) + _U((ring << 32) + 1 + kind))), len(some) - differ if rich else 1))
        return rich


def packed(values: np.ndarray, first: int, kind: type) -> bytes:
    """Sorted values from `first` on as their steps; the largest number of the kind is a step of that length without a value."""
    most = np.iinfo(kind).max
    far, step = np.divmod(np.diff(values, prepend=_U(first)), _U(most))
    at = np.cumsum(far.astype(np.int64) + 1) - 1
    out = np.full(at[-1] + 1 if len(at) else 0, most, kind)
    out[at] = step
    return out.tobytes()


def unpacked(raw, first: int, kind: type) -> np.ndarray:
    steps = np.frombuffer(raw, kind)
    return (np.cumsum(steps, dtype=np.uint64) + _U(first))[steps != np.iinfo(kind).max]


def _starts(buckets: int, bits: int) -> np.ndarray:
    return np.array([(j << bits) // buckets for j in range(buckets)], np.uint64)


def common_shingles(docs: DataFrame, words: int, n: int) -> np.ndarray:
    """Sorted first halves of the hashes of the shingles in COMMON or more of all texts of docs (node, text), the KNOWN most common at most.

    n: about how many shingles the texts have.
    """
    return most_common(shapes(docs.select("node", F.lit(None).cast("long").alias("doc_id"), "text"), words), n)


def most_common(counted: DataFrame, n: int) -> np.ndarray:
    """What common_shingles gives, of the halves that the bodies of shapes() hold."""
    starts = _starts(max(1, math.ceil(n / GROUPED)), 32)

    def dealt(batches):
        for batch in batches:
            for raw in batch.column(0):
                values = unpacked(raw.as_buffer(), 0, np.uint16)
                cut = np.append(np.searchsorted(values, starts), len(values))
                some = np.flatnonzero(np.diff(cut))
                body = [packed(values[cut[j] : cut[j + 1]], int(starts[j]), np.uint16) for j in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(body, pa.binary())], names=["bucket", "body"])
                del values
            released()

    def count(found: pa.Table) -> pa.Table:
        first = int(starts[found["bucket"][0].as_py()])
        values = np.sort(np.concatenate([unpacked(x.as_buffer(), first, np.uint16).astype(np.uint32) for x in found["body"]]))
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        times = np.diff(np.append(at, len(values)))
        often = times >= COMMON
        out = pa.table({"shingle": values[at[often]].astype(np.int64), "n": times[often].astype(np.int64)})
        del values, at, times
        released()
        return out

    found = counted.where("body is not null").select("body").mapInArrow(dealt, "bucket int, body binary").groupBy("bucket").applyInArrow(count, "shingle long, n long")
    # A million hashes at most, whatever the input.
    best = found.orderBy(F.desc("n"), "shingle").limit(KNOWN).select("shingle").toArrow()["shingle"]
    return np.sort(best.to_numpy().astype(np.uint32))


def _numbered(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text) of docs (doc_id, text): node is the doc_id where it belongs to one row, else a number from the row's own hash."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = F.lit(OWN_IDS) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1))
    again = materialize(slim.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-again")
    n = again.count()
    if not n:
        forget(again)
        return slim.select(F.coalesce("doc_id", own).alias("node"), "doc_id", "text")
    again = again.withColumn("_again", F.lit(True))
    slim = slim.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "doc_id", "left")
    return slim.select(F.when(F.col("_again") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id")).alias("node"), "doc_id", "text")


def shapes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, doc_id, n_shingles, f1, f2, body) of docs (node, doc_id, text).

    Further rows have a body alone: the first halves of the hashes of about SENT shingles, as steps of 16 bits, so that texts are
    cut into shingles once for both.
    """
    names = ["node", "doc_id", "n_shingles", "f1", "f2", "body"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        body = packed(np.sort(np.concatenate(held)).astype(np.uint64), 0, np.uint16)
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.array([body], pa.binary())], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in in_slices(batch, 2):
                sets = shingle_sets(part.column(2), words)
                with np.errstate(over="ignore"):
                    f1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                    f2 = np.array([mixed(x + _U(77)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                own = [pa.array([len(x) for x in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own], names=names)
                held.append((np.concatenate([np.empty(0, np.uint64), *sets]) >> _U(32)).astype(np.uint32))
                size += len(held[-1])
                if size >= SENT:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return docs.select("node", "doc_id", "text").mapInArrow(run, "node long, doc_id long, n_shingles long, f1 long, f2 long, body binary")


def _near_ids(node: np.ndarray) -> tuple[int, int, bytes]:
    """(base, bytes of a number, numbers from base on)."""
    base, last = int(node.min()), int(node.max())
    kind = next((k for k in (np.uint16, np.uint32) if last - base <= np.iinfo(k).max), None)
    return (0, 8, node.tobytes()) if kind is None else (base, kind().itemsize, (node - base).astype(kind).tobytes())


def _near_ids_read(base: int, width: int, raw) -> np.ndarray:
    return np.frombuffer(raw, np.int64) if width == 8 else np.frombuffer(raw, f"u{width}").astype(np.int64) + base


def key_bytes(flat: np.ndarray, held: np.ndarray) -> pa.Array:
    """The first KEY_BYTES bytes of keys, of which every row holds so many."""
    raw = (flat.view(np.uint64) >> _U(64 - 8 * KEY_BYTES)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
    at = np.concatenate([[0], KEY_BYTES * np.cumsum(held)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def key_bytes_read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all rows in their order, keys that every row holds)."""
    held = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // KEY_BYTES
    out = np.zeros((int(held.sum()), 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel(), held


def region_keys(docs: DataFrame, words: int, percent: int, common: np.ndarray | None) -> DataFrame:
    """(node, sampled, others) of docs (node, text): the keys of every text's regions, those of the sample and the others."""

    def run(batches):
        regions = Regions(percent, common)
        for batch in batches:
            for part in in_slices(batch):
                sets = shingle_sets(part.column(1), words)
                own = [regions.keys(x, y) for x, y in zip(sets, regions.rare(sets), strict=True)]
                flat, of = np.concatenate([np.empty(0, np.int64), *own]), np.repeat(np.arange(len(own)), [len(k) for k in own])
                first = flat % SAMPLED == 0
                kinds = [key_bytes(flat[x], np.bincount(of[x], minlength=len(own))) for x in (first, ~first)]
                yield pa.RecordBatch.from_arrays([part.column(0), *kinds], names=["node", "sampled", "others"])

    return docs.select("node", "text").mapInArrow(run, "node long, sampled binary, others binary")


def chained(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, common: np.ndarray | None = None, n: int = 0) -> DataFrame:
    """Edges (u, v) that connect all texts of docs (node, text) that share a region; n: about how many shingles they have.

    Of texts that share most of their regions every task would send an edge. So a sample of the regions is met first, and what it
    connects is one node for the others, whose tasks then only send what is new: what texts with few regions in common share.
    The keys of the regions are stored in between, so that each text is cut into shingles once.
    """
    keys, alone = region_keys(docs, words, percent, common), F.lit(None).cast("long").alias("head")
    if n <= GROUPED:
        return _chained(keys.select("node", F.concat("sampled", "others").alias("keys"), alone), n)
    keys = materialize(keys, "jaccard-keys")
    found = connected_components(_chained(keys.select("node", F.col("sampled").alias("keys"), alone), n // SAMPLED), "jaccard-sample")
    heads = materialize(found.where("node <> component").select("node", F.col("component").alias("head")), "jaccard-heads")
    others = attached(keys.select("node", F.col("others").alias("keys")), heads, "node", BROADCAST_ROWS, "left").select("node", "keys", "head")
    edges = materialize(_chained(others, n).unionByName(heads.select(F.col("node").alias("u"), F.col("head").alias("v"))), "jaccard-edges")
    forget(keys)
    forget(heads)
    return edges


def _chained(docs: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) between the nodes of docs (node, keys, head) that share a region; a head stands for its nodes.

    A task chains the texts that share a region as far as it holds them, and sends each region with one of them. Regions are told
    by 48 bits here, sent as steps of 32 bits; what that puts together by chance is compared like the rest.
    """
    starts = _starts(max(1, math.ceil(n / GROUPED)), 8 * KEY_BYTES)

    def rows(keys: list[np.ndarray], nodes: list[np.ndarray], moved: list[np.ndarray]) -> pa.RecordBatch:
        flat, node, far = np.concatenate(keys), np.concatenate(nodes), np.concatenate(moved)
        order = np.argsort(flat, kind="stable")
        flat, node, far = flat[order], node[order], far[order]
        first = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        low = np.repeat(node[first], np.diff(np.append(np.flatnonzero(first), len(flat))))
        u, v = contracted(node[~first], low[~first])
        del order, low
        out = []
        # Heads may be far from the nodes of a task, whose numbers take fewer bytes by themselves.
        for kind in (first & ~far, first & far):
            key, own = flat[kind], node[kind]
            cut = np.append(np.searchsorted(key, starts), len(key))
            some = np.flatnonzero(np.diff(cut))
            out += [(int(j), packed(key[cut[j] : cut[j + 1]], int(starts[j]), np.uint32), *_near_ids(own[cut[j] : cut[j + 1]])) for j in some]
        if len(u):
            # Edges have no regions.
            out.append((int(u[0]) % len(starts), u.tobytes(), 0, 0, v.tobytes()))
        bucket, body, base, width, ids = zip(*out, strict=True) if out else ((),) * 5
        columns = [pa.array(x, t) for x, t in ((bucket, pa.int32()), (body, pa.binary()), (base, pa.int64()), (width, pa.int32()), (ids, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "body", "base", "width", "ids"])

    def run(batches):
        keys, nodes, moved, size = [], [], [], 0
        for batch in batches:
            for part in in_slices(batch):
                own, held = key_bytes_read(part.column(1))
                keys.append(own)
                nodes.append(np.repeat(pc.coalesce(part.column(2), part.column(0)).to_numpy(), held))
                moved.append(np.repeat(pc.is_valid(part.column(2)).to_numpy(zero_copy_only=False), held))
                size += len(keys[-1])
                if size >= SENT:
                    yield rows(keys, nodes, moved)
                    keys, nodes, moved, size = [], [], [], 0
        if keys:
            yield rows(keys, nodes, moved)
        del keys, nodes, moved
        released()

    def met(found: pa.Table) -> pa.Table:
        start = int(starts[found["bucket"][0].as_py()])
        flat, node, u, v = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], []
        for body, base, width, ids in zip(found["body"], found["base"].to_pylist(), found["width"].to_pylist(), found["ids"], strict=True):
            if width:
                flat.append(unpacked(body.as_buffer(), start, np.uint32))
                node.append(_near_ids_read(base, width, ids.as_buffer()))
            else:
                u.append(np.frombuffer(body.as_buffer(), np.int64))
                v.append(np.frombuffer(ids.as_buffer(), np.int64))
        flat, node = np.concatenate(flat), np.concatenate(node)
        order = np.argsort(flat, kind="stable")
        flat, node = flat[order], node[order]
        first = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        low = np.repeat(node[first], np.diff(np.append(np.flatnonzero(first), len(flat))))
        u, v = contracted(np.concatenate([*u, node[~first]]), np.concatenate([*v, low[~first]]))
        del flat, node, order, low
        released()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = docs.select("node", "keys", "head").mapInArrow(run, "bucket int, body binary, base long, width int, ids binary")
    return found.groupBy("bucket").applyInArrow(met, "u long, v long")


def finer(texts: DataFrame, words: int, percent: int, common: np.ndarray | None, buckets: int) -> DataFrame:
    """Edges (u, v) between texts (node, text) that share as many regions as linked ones do.

    Regions of more than PAIRED texts connect all of them; in others the shared regions of every pair are counted, so that a chance
    passage of a few short texts chains nothing.
    """

    def run(batches):
        regions = Regions(percent, common)
        for batch in batches:
            for part in in_slices(batch):
                sets = shingle_sets(part.column(1), words)
                own = [regions.spared(x, y) for x, y in zip(sets, regions.rare(sets), strict=True)]
                node = np.repeat(part.column(0).to_numpy(), [len(k) for k, _ in own])
                flat = [np.concatenate([np.empty(0, t), *[x[i] for x in own]]) for i, t in enumerate((np.int64, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(node), pa.array(flat[1])], names=["key", "node", "spare"])

    def pairs(found: pa.Table) -> pa.Table:
        key, node, spare = (found[c].to_numpy() for c in ("key", "node", "spare"))
        order = np.lexsort((node, key))
        key, node, spare = key[order], node[order], spare[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        big = np.repeat(size > PAIRED, size)
        low = np.repeat(node[at], size)
        u, v = contracted(node[big], low[big])
        out = [(u, v, np.zeros(len(u), np.int64))]
        for g in np.unique(size[(size > 1) & (size <= PAIRED)]).tolist():
            one, two = np.triu_indices(g, 1)
            of = at[size == g][:, None]
            a, b = (of + one).ravel(), (of + two).ravel()
            out.append((node[a], node[b], np.minimum(spare[a], spare[b])))
        u, v, need = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"u": u, "v": v, "need": need})

    keys = texts.select("node", "text").mapInArrow(run, "key long, node long, spare int")
    met = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(pairs, "u long, v long, need long")
    return met.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("u", "v")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    rank = np.cumsum(count > 1) - 1
    at, of = rank[at[shared]], of[shared]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, [a, a + columns])
        some = np.zeros((n, columns), np.float32)
        some[of[lo:hi], at[lo:hi] - a] = 1.0
        out += some @ some.T
    return out


def forest(sets: list[np.ndarray], cross: int = 0, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the links between the sets; with cross only links of the first `cross` to the others count."""
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets).astype(np.float64)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    link &= (size > 0)[:, None]
    if cross:
        link[:cross, :cross] = False
        link[cross:, cross:] = False
    else:
        np.fill_diagonal(link, False)
    out, seen = [], np.zeros(len(sets), bool)
    for start in range(len(sets)):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(link[x] & ~seen)
            seen[near] = True
            out += [(int(y), x) for y in near]
            todo += near.tolist()
    return out


def _unpacked(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _links(percent: int, words: int):
    """Links of every (region, one, two) of a task, as edges of nodes; rows hold sets or, where each is met once, texts."""

    def found(rows: pa.Table) -> pa.Table:
        names = ("region", "one", "two", "block", "node")
        region, one, two, block, node = (rows[c].to_numpy() for c in names)
        sets = _unpacked(rows["set"]) if "set" in rows.column_names else shingle_sets(rows["text"].combine_chunks(), words)
        order = np.lexsort((node, block, two, one, region))
        change = np.flatnonzero(np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (region, one, two)], axis=0)))
        u, v = [], []
        for own in np.split(order, change[1:]):
            first = one[own[0]]
            cross = int((block[own] == first).sum()) if first != two[own[0]] else 0
            for a, b in forest([sets[i] for i in own], cross, percent):
                u.append(int(node[own[a]]))
                v.append(int(node[own[b]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(rows: pa.Table) -> pa.Table:
        out = found(rows)
        released()
        return out

    return run


def _set_rows(texts: DataFrame, words: int, common: np.ndarray | None) -> DataFrame:
    """(region, node, set, odd) of texts (region, node, text): the sets as binary, and how many of their shingles are not common."""

    def run(batches):
        regions = Regions(common=common)
        for batch in batches:
            for part in in_slices(batch, 2):
                sets = shingle_sets(part.column(2), words)
                odd = [len(x) for x in regions.rare(sets)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(odd, pa.int32())], names=["region", "node", "set", "odd"])

    return texts.select("region", "node", "text").mapInArrow(run, "region long, node long, set binary, odd int")


def to_pivots(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, links) of sets to pivots."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    gaps, links = np.empty((len(sets), len(pivots))), np.zeros((len(sets), len(pivots)), bool)
    for k, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        both = np.bincount(of[pivot[at] == flat], minlength=len(sets))
        union = size + len(pivot) - both
        gaps[:, k], links[:, k] = 1.0 - both / union, 100 * both >= percent * union
    return gaps, links


def _placed(percent: int):
    """Of a region's block and its pivots: home pivot of every row, earlier pivots in its window, and pivots that it links to."""
    window = 2 * (100 - percent) / 100 + 1e-9

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        order = np.argsort(pivots["pivot"].to_numpy())
        pivots = pivots.take(pa.array(order))
        gaps, links = to_pivots(_unpacked(rows["set"]), _unpacked(pivots["set"]), percent)
        node, own = rows["node"].to_numpy(), pivots["node"].to_numpy()
        home = gaps.argmin(axis=1)
        near = gaps <= gaps.min(axis=1, keepdims=True) + window
        near &= np.arange(len(own))[None, :] < home[:, None]
        links &= node[:, None] != own[None, :]
        held = links | (node[:, None] == own[None, :])
        numbers = pivots["pivot"].to_numpy()
        mask = (held * (1 << numbers.astype(np.int64))[None, :]).sum(axis=1)
        lists = [pa.array([at[row].tolist() for row in what], pa.list_(t)) for what, at, t in ((near, numbers, pa.int32()), (links, own, pa.int64()))]
        return pa.table([rows["region"], rows["node"], rows["set"], rows["odd"], rows["comp"], pa.array(numbers[home].astype(np.int32)), pa.array(mask), *lists], names=["region", "node", "set", "odd", "comp", "home", "mask", "near", "links"])

    return run


def _labels(frames):
    """(region, labels): for each pivot number the component that what links to it belongs to."""
    for frame in frames:
        out = []
        for pivots, masks in zip(frame["pivots"], frame["masks"], strict=True):
            groups = [1 << p["pivot"] for p in pivots]
            for m in masks:
                touched = [g for g in groups if g & m]
                groups = [g for g in groups if not g & m] + ([functools.reduce(int.__or__, touched)] if touched else [])
            label = [None] * PIVOTS
            for g in groups:
                inside = [p for p in pivots if g >> p["pivot"] & 1]
                known = [p["comp"] for p in inside if p["comp"] is not None]
                for p in inside:
                    label[p["pivot"]] = min(known) if known else min(q["node"] for q in inside)
            out.append(label)
        yield pd.DataFrame({"region": frame["region"], "labels": out})


def _voronoi(rows: DataFrame, sizes: DataFrame, level: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows in their new regions, links to pivots) of rows (region, node, set, odd, comp) and sizes (region, blocks).

    Of PIVOTS parts of a region, dealt by hash, the text with the fewest odd shingles is the pivot: copies of a text link to the
    least changed of them.
    """
    turn = F.xxhash64("node", F.lit(level))
    pick = F.min_by(F.struct("node", "set", "comp"), F.struct("odd", turn.alias("turn"), "node"))
    pivots = rows.groupBy("region", F.pmod(turn, F.lit(PIVOTS)).cast("int").alias("pivot")).agg(pick.alias("p")).select("region", "pivot", "p.*")
    pivots = materialize(pivots, "jaccard-pivots")
    dealt = attached(rows, sizes.select("region", "blocks"), "region", BROADCAST_ROWS)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    to_blocks = pivots.join(sizes.select("region", "blocks"), "region").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["region", "block"]
    schema = "region long, node long, set binary, odd int, comp long, home int, mask long, near array<int>, links array<long>"
    placed = materialize(dealt.groupBy(*key).cogroup(to_blocks.groupBy(*key)).applyInArrow(_placed(percent), schema), "jaccard-placed")
    edges = placed.select(F.col("node").alias("u"), F.explode("links").alias("v"))
    masks = placed.where("mask > 0").groupBy("region").agg(F.collect_set("mask").alias("masks"))
    own = pivots.groupBy("region").agg(F.collect_list(F.struct("pivot", "node", "comp")).alias("pivots"))
    labels = own.join(masks, "region").mapInPandas(_labels, "region long, labels array<long>")
    known = attached(placed, labels, "region", BROADCAST_ROWS, "left")
    first = F.length(F.bin("mask")) - 1
    comp = F.coalesce("comp", F.when(F.col("mask") > 0, F.get("labels", first)))
    spots = known.select("node", "set", "odd", comp.alias("comp"), "region", F.posexplode(F.concat(F.array("home"), "near")).alias("guest", "pivot"))
    return spots.select(F.xxhash64("region", "pivot", F.lit(level)).alias("region"), "node", "set", "odd", "comp", F.col("region").alias("within"), (F.col("guest") > 0).alias("guest")), edges


def _sized(rows: DataFrame, *key: str) -> DataFrame:
    """(key, n, blocks, cost) of rows: cost is the pairs of rows that are not known to be connected."""
    kinds = rows.groupBy(*key, "comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("bytes"))
    n = F.sum("n").cast("double")
    known = F.coalesce(F.sum(F.when(F.col("comp").isNotNull(), F.col("n").cast("double") * F.col("n"))), F.lit(0.0))
    blocks = F.ceil(F.greatest(n / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("long")
    return kinds.groupBy(*key).agg(F.sum("n").alias("n"), blocks.alias("blocks"), (n * n - known).alias("cost")).where("n > 1 and cost > 0")


def _paired(rows: DataFrame) -> DataFrame:
    """(region, node, set, block, one, two, task) of rows of regions that need several blocks: every row once for each pair of blocks it is in.

    Rows of one component are in blocks of their own, which meet only other blocks.
    """
    bytes_, n = F.sum(F.octet_length("set")), F.count("*")
    kinds = rows.groupBy("region", "comp").agg(F.ceil(F.greatest(n / BLOCK, bytes_ / BLOCK_BYTES)).cast("long").alias("own"))
    in_order = Window.partitionBy("region").orderBy(F.col("comp").asc_nulls_first())
    kinds = kinds.withColumn("base", F.sum("own").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("all", F.sum("own").over(Window.partitionBy("region")))
    kinds = kinds.select(F.struct("region", "comp").alias("kind"), "own", F.coalesce("base", F.lit(0)).alias("base"), "all")
    known = attached(rows.withColumn("kind", F.struct("region", "comp")), kinds, "kind", BROADCAST_ROWS)
    block = F.col("base") + F.pmod(F.xxhash64("node"), F.col("own"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda k: F.col("comp").isNull() | (k < F.col("base")) | (k >= F.col("base") + F.col("own")))
    spread = known.select("region", "node", "set", block.alias("block"), F.explode(others).alias("other"))
    spread = spread.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other")
    return spread.withColumn("task", F.xxhash64("region", "one", "two"))


def links_of(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, common: np.ndarray | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(edges (u, v) of a forest of the links inside the clusters of texts (region, node, text), tables to forget)."""
    own = ["region", "node", "set", "odd", "comp"]
    inside = lambda rows, keys, key="region": attached(rows, keys.select(key), key, BROADCAST_ROWS)
    in_one = [F.lit(0).cast("long").alias(c) for c in ("block", "one", "two")]
    shared = lambda load: F.pmod(F.xxhash64("region"), F.lit(max(64, math.ceil(load / SHARED_BYTES))))
    texts = materialize(texts.select("region", "node", "text"), "jaccard-texts")
    # A set takes about three bytes for one of text.
    n, load = F.count("*"), 3 * F.sum(F.octet_length("text"))
    size = lambda rows: materialize(
        rows.groupBy("region").agg(n.alias("n"), load.alias("bytes"), F.ceil(F.greatest(n / BLOCK, load / BLOCK_BYTES)).cast("long").alias("blocks")).where("n > 1"), "jaccard-sizes"
    )
    sizes = size(texts)
    stored = [texts, sizes]
    heavy = sizes.where("blocks > 1").agg(F.sum("bytes")).first()[0]
    if heavy:
        large = inside(texts, sizes.where("blocks > 1")).select("node", "text")
        again = connected_components(finer(large, words, percent, common, math.ceil(heavy / BLOCK_BYTES)), "jaccard-finer")
        again = materialize(again.select("node", F.col("component").alias("region")), "jaccard-again")
        # A component is named by a node of its own cluster, so the names differ from those of the small clusters.
        small = inside(texts, sizes.where("blocks = 1")).select("region", "node", "text")
        texts = materialize(small.unionByName(attached(large, again, "node", BROADCAST_ROWS).select("region", "node", "text")), "jaccard-texts")
        sizes = size(texts)
        stored += [again, texts, sizes]
    small = inside(texts, sizes.where("blocks = 1")).select("region", "node", "text", *in_one)
    small = small.withColumn("task", shared(sizes.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0))
    edges, tasks = [small.groupBy("task").applyInArrow(_links(percent, words), "u long, v long")], []
    rows = materialize(_set_rows(inside(texts, sizes.where("blocks > 1")), words, common).withColumn("comp", F.lit(None).cast("long")), "jaccard-members")
    stored.append(rows)
    sizes = materialize(_sized(rows, "region"), "jaccard-sizes")
    stored.append(sizes)
    for level in range(LEVELS + 1):
        whole = inside(rows, sizes.where("blocks = 1")).select("region", "node", "set", *in_one)
        load = whole.agg(F.sum(F.octet_length("set"))).first()[0] or 0
        if load:
            tasks.append(whole.withColumn("task", shared(load)))
        large = sizes.where("blocks > 1")
        if large.isEmpty():
            break
        rows = inside(rows.select(*own), large)
        if level == LEVELS:
            tasks.append(_paired(rows))
            break
        cut, found = _voronoi(rows, large, level, percent)
        cut = materialize(cut, "jaccard-rows")
        home = cut.where("not guest").select(F.col("within").alias("region"), "node", "set", "comp")
        after = materialize(_sized(cut, "within", "region"), "jaccard-sizes")
        left = after.groupBy("within").agg(F.sum("cost").alias("left"))
        judged = _sized(home, "region").withColumnRenamed("region", "within").join(left, "within", "left")
        judged = materialize(judged.withColumn("worth", F.coalesce("left", F.lit(0.0)) <= SHRINK * F.col("cost")), "jaccard-judged")
        stored += [cut, after, judged]
        edges.append(found)
        stay = judged.where("not worth").select(F.col("within").alias("region"))
        if not stay.isEmpty():
            tasks.append(_paired(inside(home, stay)))
        go = judged.where("worth")
        rows, sizes = inside(cut, go, "within"), inside(after, go, "within")
    if tasks:
        edges.append(functools.reduce(DataFrame.unionByName, tasks).groupBy("task").applyInArrow(_links(percent, words), "u long, v long"))
    return functools.reduce(DataFrame.union, edges), stored


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, doc_id, n_shingles, component) of every row of docs (node, doc_id, text); component is a node of its own, null without shingles."""
    counted = materialize(shapes(docs, words), "jaccard-counted")
    signed = materialize(counted.where("n_shingles is not null").drop("body"), "jaccard-sets")
    shape = F.struct("f1", "f2", "n_shingles")
    some = signed.where("n_shingles > 0").withColumn("shape", shape)
    first = materialize(some.groupBy("shape").agg(F.min("node").alias("rep"), F.count("*").alias("copies")), "jaccard-first")
    n = signed.agg(F.sum("n_shingles")).first()[0] or 0
    common = most_common(counted, n)
    forget(counted)
    clusters = connected_components(chained(docs, words, percent, common, n), "jaccard-clusters")
    # Texts with equal sets share their regions, so one of them stands for all.
    members = materialize(clusters.select(F.col("node").alias("rep"), F.col("component").alias("region")).join(first.select("rep"), "rep").withColumnRenamed("rep", "node"), "jaccard-nodes")
    sizes = members.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    members = attached(members, sizes, "region", BROADCAST_ROWS, "inner")
    texts = attached(docs.select("node", "text"), members, "node", BROADCAST_ROWS, "inner").dropDuplicates(["node"])
    edges, stored = links_of(texts, words, percent, common)
    found = materialize(connected_components(edges, "jaccard-links"), "jaccard-joined")
    reps = materialize(first.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("shape", F.coalesce("component", "rep").alias("component")), "jaccard-reps")
    out = salted_lookup(some.select("node", "doc_id", "n_shingles", "shape"), reps, "shape").select("node", "doc_id", "n_shingles", "component")
    out = materialize(out.unionByName(signed.where("n_shingles = 0").select("node", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))), "jaccard-out")
    for done in (signed, first, members, found, reps, *stored):
        forget(done)
    return out


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    found = components(_numbered(docs), words, percent)
    named = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = salted_lookup(found.where("component is not null"), named, "component").select("doc_id", "n_shingles", "component_id")
    return known.unionByName(found.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of docs, that of the smallest doc_id (a null one last); rows without shingles stay."""
    node = fresh(docs.columns, "_node")
    # The numbers of rows are those that components() sees.
    slim = _numbered(docs)
    found = components(slim, words, percent).where("component is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    kept = found.groupBy("component").agg(F.min_by("node", order).alias("kept"))
    gone = materialize(salted_lookup(found, kept, "component").where("node <> kept").select("node").distinct(), "jaccard-gone")
    again = materialize(found.groupBy("node").count().where("count > 1").select("node"), "jaccard-again")
    own = F.lit(OWN_IDS) + F.xxhash64(F.col("doc_id").cast("long"), "text").bitwiseAND(F.lit(2**62 - 1))
    odd = materialize(found.where(F.col("node") < OWN_IDS // 2).select("doc_id").where("doc_id is not null").distinct(), "jaccard-odd")
    rows = docs
    if odd.isEmpty():
        rows = rows.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), own))
    else:
        flag = fresh(docs.columns, "_odd")
        rows = _joined(rows, odd.select(F.col("doc_id").alias(node), F.lit(True).alias(flag)), F.col("doc_id").cast("long") == F.col(node), "left")
        rows = rows.withColumn(node, F.when(F.col(flag) | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id").cast("long")))
    rows = _joined(rows, gone.withColumnRenamed("node", node), node, "left_anti")
    if again.isEmpty():
        return rows.select(*docs.columns)
    again = again.withColumnRenamed("node", node)
    once = _joined(rows, again, node, "left_semi").dropDuplicates([node])
    return _joined(rows, again, node, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def _joined(rows: DataFrame, ids: DataFrame, on: str | Column, how: str) -> DataFrame:
    """rows joined with ids; few ids are broadcast, more of them shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
