"""op2, op3 and op6 against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarryline.llm import covertree, hamming, jaccard
from quarryline.llm._shared import connected_components, salted_lookup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)


def brute_jaccard(rows, words=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    union = Union(sets)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def _texts(seed=3):
    """Families of near copies, with one large family whose members mostly differ by more than the threshold."""
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        base = random.Random(i % 30)
        words = [base.choice("abcdefghijklmnop") + base.choice("xyz") for _ in range(base.choice([1, 2, 3, 9, 12, 25, 60, 150]))]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice("qrstuv")
        rows.append((i, " ".join(words)))
    master = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(150)]
    for i in range(700, 1000):
        words = list(master)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B")]


@pytest.mark.parametrize(("block", "words", "percent"), [(jaccard.BLOCK, 3, 90), (40, 3, 90), (25, 5, 80)])
def test_jaccard(spark, monkeypatch, block, words, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = _texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
    assert got == brute_jaccard(rows, words, percent)


def test_common_passages_chain_nothing(spark):
    """Texts that share a passage of 60 words are found apart, and linked copies of them together."""
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(400):
        own = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(rng.choice([20, 150]))]
        rows.append((i, " ".join(own[:10]) + f" {passage} " + " ".join(own[10:])))
        if i % 20 == 0:
            rows.append((1000 + i, rows[-1][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 90), (5, 80)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, words, percent).collect()} == brute_jaccard(rows, words, percent)
        numbered = docs.selectExpr("doc_id AS node", "doc_id", "text")
        common = jaccard.common_shingles(numbered, words, len(rows))
        assert len(common) >= 61 - words
        long = [r.node for r in numbered.where("size(split(text, ' ')) > 200").collect()]
        clusters = {r.node: r.component for r in connected_components(jaccard.chained(numbered, words, percent, common)).collect()}
        assert len({clusters.get(i, i) for i in long}) > 0.8 * len([i for i in long if i < 1000])


def test_chance_passages_are_not_compared_in_blocks(spark, monkeypatch):
    """Short texts that passages connect with a few others are a large cluster, and none of its blocks meet."""
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    compared = []
    paired = jaccard._paired
    monkeypatch.setattr(jaccard, "_paired", lambda rows: compared.append(paired(rows).count()) or paired(rows))
    passage = [" ".join(f"w{i}_{k}" for k in range(9)) for i in range(600)]
    rows = [(i, f"{passage[i]} a{i} b{i} {passage[(i + 1) % 600]} c{i} d{i} {passage[7 * i % 600]}") for i in range(600)]
    rows.append((1000, f"{rows[7][1]} end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, 5, 80).collect()} == brute_jaccard(rows, 5, 80)
    clusters = connected_components(jaccard.chained(docs.withColumnRenamed("doc_id", "node"), 5, 80)).groupBy("component").count()
    assert clusters.agg({"count": "max"}).first()[0] > 40 and sum(compared) == 0


def test_linked_texts_are_not_sent_by_every_task(spark, monkeypatch):
    """4 times the texts, met in 4 times the tasks, make about 4 times the edges, and the clusters of a single task."""
    rng, made = random.Random(4), []
    for n in (100, 400):
        words = [[f"w{rng.randrange(10**7)}" for _ in range(300)] for _ in range(n)]
        # Near copies, and texts that share half of their words, lie in other tasks than the texts.
        kinds = [words, [[*w, "end"] for w in words], [w[:150] + [f"x{rng.randrange(10**7)}" for _ in range(150)] for w in words]]
        rows = [(k * n + i, " ".join(w)) for k, kind in enumerate(kinds) for i, w in enumerate(kind)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "node long, text string")
        alone = {r.node: r.component for r in connected_components(jaccard.chained(docs, 5, 80)).collect()}
        monkeypatch.setattr(jaccard, "GROUPED", 2000)
        edges = spark.createDataFrame(jaccard.chained(docs, 5, 80, None, 900 * n).toPandas())
        monkeypatch.undo()
        assert {r.node: r.component for r in connected_components(edges).collect()} == alone
        assert all(alone[i] == alone[n + i] == i for i in range(n))
        made.append(edges.count())
    assert made[1] < 6 * made[0]


def test_small_sets_in_one_part_share_a_region():
    """Sets that link share a region where all their shingles fall into one part, as many as both can spare."""
    rng = np.random.default_rng(5)
    for percent, n in ((80, 5), (80, 8), (90, 10)):
        for _ in range(50):
            full = np.sort(rng.integers(0, 2**62, n, dtype=np.uint64))
            for common in (None, (full[:2] >> np.uint64(32)).astype(np.uint32), np.empty(0, np.uint32)):
                regions = jaccard.Regions(percent, common)
                found = [dict(zip(*(x.tolist() for x in regions.spared(s, regions.rare([s])[0])), strict=True)) for s in (full, full[1:])]
                both = found[0].keys() & found[1].keys()
                assert len(both) >= max(1, min([min(f[k] for f in found) for k in both], default=1))


@pytest.mark.parametrize(("kind", "bits"), [(np.uint16, 32), (np.uint32, 48)])
def test_packed_values_come_back(kind, bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 5000):
        values = np.sort(rng.integers(2**20, 2**bits, n, dtype=np.uint64).repeat(2))
        assert (jaccard.unpacked(jaccard.packed(values, 2**20, kind), 2**20, kind) == values).all()


def test_texts_are_read_three_times(spark, monkeypatch, tmp_path):
    """Texts are cut once for their sets and the common shingles, once for all their regions, and once where they are compared."""
    monkeypatch.setattr(jaccard, "GROUPED", 2000)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, f"{t} end") for i, t in rows[:50]]
    log = str(tmp_path / "read")

    def noted(batches):
        for batch in batches:
            with open(log, "a") as out:
                out.write(f"{len(batch)}\n")
            yield batch

    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, doc_id long, text string")
    found = jaccard.components(docs.mapInArrow(noted, docs.schema)).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in found} == brute_jaccard(rows)
    assert sum(int(n) for n in open(log)) <= 3 * len(rows)


def test_word_hashes_are_those_of_xxhash():
    rng = random.Random(2)
    words = ["", *("".join(rng.choice("ab\0\u00e9\U0001f600") for _ in range(n)) for n in range(1, 80) for _ in range(20))]
    wanted = [xxhash.xxh64_intdigest(w) for w in words]
    for kind in (pa.string(), pa.large_string()):
        assert jaccard.word_hashes(pa.array(words, kind)).tolist() == wanted
        assert jaccard.word_hashes(pa.array(words, kind)[5:90]).tolist() == wanted[5:90]
    assert len(jaccard.word_hashes(pa.array([], pa.string()))) == 0


def test_keys_come_back_by_their_first_bytes():
    keys = np.random.default_rng(6).integers(-(2**63), 2**63, 100)
    for held in ([0, 3, 0, 97], [100], [0] * 4 + [100, 0]):
        own, rows = jaccard.key_bytes_read(jaccard.key_bytes(keys, np.array(held)))
        assert (own == keys.view(np.uint64) >> np.uint64(16)).all() and rows.tolist() == held
        tail, rows = jaccard.key_bytes_read(jaccard.key_bytes(keys, np.array(held))[1:])
        assert (tail == own[held[0] :]).all() and rows.tolist() == held[1:]


def test_common_shingles_are_counted_in_all_texts(spark):
    """What COMMON texts hold is common, and what one text fewer holds is not, however many texts there are."""
    passages = [f"p{k} q{k} r{k}" for k in range(40)]
    rows = [(100 * k + i, f"a{k}_{i} {x} b{k}_{i}") for k, x in enumerate(passages) for i in range(jaccard.COMMON - k % 2)]
    rows += [(10_000 + i, f"c{i} d{i} e{i} f{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "node long, text string")
    wanted = {int(jaccard.shingle_sets(pa.array([x]), 3)[0][0]) >> 32 for x in passages[::2]}
    assert set(jaccard.common_shingles(docs, 3, 10**7).tolist()) == wanted


def test_near_copies_take_linear_work(spark, monkeypatch):
    """Of 4 times the copies of a text, which all link to it and mostly not to each other, about 4 times the rows are compared."""
    compared = []
    paired = jaccard._paired
    monkeypatch.setattr(jaccard, "_paired", lambda rows: compared.append(paired(rows).count()) or paired(rows))
    rng, work = random.Random(9), []
    master = [f"m{k}" for k in range(120)]
    for n in (4000, 16_000):
        rows = []
        for i in range(n):
            words = list(master)
            for _ in range(rng.choice([0, 1, 1, 2, 2])):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        compared.clear()
        found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
        assert found.groupBy("component_id").count().agg({"count": "max"}).first()[0] > 0.99 * n
        work.append(sum(compared) + n)
    assert work[1] < 6 * work[0]


def test_rows_that_share_ids(spark):
    """Rows without an id, or that share one with another text, link and bridge by their own texts."""
    words = [f"w{k}" for k in range(100)]
    text = lambda *changed: " ".join("x" if k in changed else w for k, w in enumerate(words))
    rows = [(1, text()), (2, text(3)), (2, "quite another text"), (None, text(3, 4)), (3, "quite another text"), (None, "no copy of anything at all"), (None, None), (2, text(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == sorted([("1", 98, 1), ("2", 98, 1), ("2", 1, 2), ("None", 98, 1), ("3", 1, 2), ("None", 4, None), ("None", 0, None), ("2", 98, 1)])
    kept = sorted((str(r.doc_id), r.text or "") for r in jaccard.keep_first(docs).collect())
    assert kept == sorted([("1", text()), ("2", "quite another text"), ("None", "no copy of anything at all"), ("None", "")])


def test_jaccard_on_table(spark, sf, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op3_jaccard(spark, sf).collect()} == brute_jaccard(texts.items())


def test_jaccard_odd_rows(spark, odd):
    found = jaccard.join(odd)
    assert found.count() == odd.count()
    by = {r.doc_id: r.component_id for r in found.collect()}
    assert by[4] == by[6] == by[None] == 4 and by[1] == 1 and by[2] == 2
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 8, 9]
    assert jaccard.join(odd.limit(0)).count() == 0 and jaccard.keep_first(odd.limit(0)).count() == 0


def test_links_at_the_threshold():
    """9 of 10 shingles in common link, 89 of 99 do not."""
    sets = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(100, 199, dtype=np.uint64), np.arange(100, 189, dtype=np.uint64)]
    assert jaccard.forest(sets) == [(1, 0)]


def brute_vectors(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    union, links = Union([i for i, _ in rows]), dict.fromkeys((i for i, _ in rows), 0)
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    return {i: (links[i], union.find(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [4096, 60])
def test_cover_tree(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(500):
        centre = np.random.default_rng(i % 15).normal(size=6)
        rows.append((i, [float(x) for x in centre + rng.normal(size=6) * 0.2 * (i % 7) / 3]))
    rows += [(600, None), (601, [0.0] * 6), (602, [float("nan")] + [1.0] * 5), (603, []), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, rows[0][1]), (607, rows[0][1]), (608, [None] + [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(frame, block=block).collect()}
    assert got == brute_vectors(rows)


def test_cover_tree_edges(spark):
    schema = "vec_id long, vector array<double>"
    assert covertree.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = covertree.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [5.0, -1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 3), (3, 2, 3), (3, 2, 3)]


def test_hamming_within_is_exact():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    codes[:50] = codes[0] ^ (rng.random((50, 8)) < 0.1).astype(np.uint8)
    index = hamming.Index(codes)
    for radius in (0, 1, 7, 8, 9, 20, 40, 64):
        expected = np.flatnonzero(hamming.POP[codes ^ codes[0]].sum(axis=1, dtype=int) <= radius)
        assert index.within(codes[0], radius).tolist() == expected.tolist()


def test_search_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hits = total = 0
    for q, own in hamming.op6_hamming(spark, sf).toPandas().groupby("query_id"):
        d = hamming.exact(x[ids == q][0], x)
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
        assert own["rank"].tolist() == list(range(1, 11)) and (own.score.diff().dropna() >= 0).all()
    assert hits >= 0.9 * total


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (100, [0.0, 0.0]), (3, [1.0, float("nan")]), (200, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0]), (5, []), (None, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    ask = lambda f: hamming.search(f, f.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))
    assert sorted(map(tuple, ask(frame).collect())) == [(0, 1, 1, 0.0), (200, 1, 4, 0.0)]
    assert ask(frame.limit(0)).count() == 0


@pytest.mark.parametrize("per_task", [10**6, 60])
def test_components(spark, per_task):
    path = spark.range(1, 120).selectExpr("id AS u", "id - 1 AS v")
    star = spark.range(1000, 1300).selectExpr("id AS u", "1000L AS v")
    got = {r.node: r.component for r in connected_components(path.union(star).union(star), per_task=per_task).collect()}
    assert got == dict.fromkeys(range(120), 0) | dict.fromkeys(range(1000, 1300), 1000)


def test_hot_keys_are_salted(spark):
    left = spark.range(2000).selectExpr("if(id < 1500, 7L, id) AS k", "id")
    right = spark.range(2000).selectExpr("id AS k", "id * 2 AS w")
    assert salted_lookup(left, right, "k").count() == 2000
    assert salted_lookup(left, right.where("k < 1900"), "k", "left").where("w IS NULL").count() == 100


def test_search_repeats_and_ties(spark):
    """A query that is given twice has ten different neighbours; equally near ones come by their ids."""
    rows = [(100, [0.5, 0.5, 0.0])] * 2 + [(i, [1.0, float(i % 3), 0.0]) for i in range(1, 31)] + [(200, [0.0, 1.0, 0.0]), (200, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = hamming.search(frame, frame.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 100)
    score = lambda v: float(np.sqrt(((np.array(v) - np.array(rows[0][1])) ** 2).sum()))
    assert own == [(k, i, s) for k, (s, i) in enumerate(sorted((score(v), i) for i, v in rows if i != 100)[:10], 1)]
    assert sorted(r["rank"] for r in found if r.query_id == 200) == sorted([*range(1, 11)] * 2)
