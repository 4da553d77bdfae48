"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and the first letters of its longer words (STEMS). Its
features are those whose share of toxic documents, in a bounded sample of labelled documents, stands out from the rest
(a signed root of the likelihood ratio); its weights are fitted on the same sample, SAMPLE documents a class at most. Labelled texts that mention an identity term
are copied with the terms of a group swapped for every other term of it, and the squared differences of the copies' logits join the
loss with weight SWAP, so a mention itself, its stems included, moves the score little. Where no labelled text mentions a term, terms have no weight.

The logit takes each feature's presence, not its count, so long texts are not toxic by length.

Defined cases: null and empty texts have no features and get the score of the intercept; without labelled rows of both
classes the score is 0 (no text is toxic); a null doc_id is not held out and has no label; of labelled rows that share a doc_id the
one of the smallest text is learned from, and all are scored; very long texts are taken whole, letter runs over 64 letters in parts of 64;
columns named score or predicted are replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, table
from ._words import in_slices, letter_words
from .language import held_out

#: Training documents a class, features, letters of stems, and documents that must hold a feature.
SAMPLE, FEATURES, STEMS, LEAST = 8000, 2048, (4, 5), 3
#: Root of the likelihood ratio that a feature needs.
STANDS_OUT = 3.5
#: Weights of the squared weights and of the squared logit differences of swapped texts.
RIDGE, SWAP, ROUNDS = 0.002, 1.0, 400
TOXIC = 0.7
#: Groups of identity terms that stand in for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("blind", "deaf", "disabled", "elderly", "young"),
)
TERMS = {w: g for g in IDENTITY for w in g}


def word_features(word: str) -> list[str]:
    """The features of a word."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def features_of(texts: pa.Array, wanted: dict[str, int] | None = None) -> list[np.ndarray | set]:
    """Of every text the distinct features; their numbers, if wanted gives them."""
    words, codes, ends = letter_words(texts)
    own = [word_features(w) for w in words.to_pylist()]
    if wanted is not None:
        own = [[wanted[f] for f in fs if f in wanted] for fs in own]
    some = np.array([bool(fs) for fs in own], bool)
    out, a = [], 0
    for b in ends.tolist():
        part = codes[a:b]
        used = np.unique(part[some[part]]).tolist() if len(part) else []
        out.append(sorted({f for c in used for f in own[c]}))
        a = b
    return out


def swapped(words: str) -> list[str]:
    """Copies of a text of lower-case words with the terms of one identity group all replaced by each term of the group."""
    tokens = words.split(" ")
    out = []
    for group in IDENTITY:
        if any(t in group for t in tokens):
            out += [" ".join(new if t in group else t for t in tokens) for new in group]
    return [t for t in out if t != words]


def swapped_texts(texts: pa.Array) -> list[list[str]]:
    """The swapped copies of every text, as its words; none for a text without identity terms."""
    words, codes, ends = letter_words(texts)
    names = words.to_pylist()
    term = np.array([w in TERMS for w in names], bool)
    out, a = [], 0
    for b in ends.tolist():
        own = codes[a:b]
        out.append(swapped(" ".join(names[c] for c in own.tolist())) if len(own) and term[own].any() else [])
        a = b
    return out


def fit_logits(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, swap: float = SWAP) -> np.ndarray:
    """Weights (the last: intercept) by accelerated gradient descent on log loss, ridge and swapped differences."""

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    of, at = flat(rows)
    of_a, at_a = flat([p for p, _ in pairs])
    of_b, at_b = flat([q for _, q in pairs])
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    w, look, t = np.zeros(n + 1), np.zeros(n + 1), 1.0
    largest = max([len(set(x)) for x in rows], default=1) + 1
    rate = 4.0 / (largest + 16.0 * RIDGE + 8 * swap * (largest if pairs else 0))
    for _ in range(ROUNDS):
        z = np.bincount(of, look[at], minlength=len(rows)) + look[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.bincount(at, gap[of], minlength=n + 1)
        grad[-1] = gap.sum()
        grad[:-1] += 2 * RIDGE * look[:-1] / max(1, n) * 10
        if pairs:
            d = np.bincount(of_a, look[at_a], minlength=len(pairs)) - np.bincount(of_b, look[at_b], minlength=len(pairs))
            d *= 2 * swap / len(pairs)
            grad += np.bincount(at_a, d[of_a], minlength=n + 1) - np.bincount(at_b, d[of_b], minlength=n + 1)
        new = look - rate * grad
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (before - 1) / t * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray] | None:
    """(features, weights) from docs (doc_id, text) and labels (doc_id, toxic) that are not held out; None without both classes."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = [marks.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "toxicity-sample")
    totals = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None
    # At most 2 * sample rows of two numbers, so the texts never move.
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def count(batches):
        for batch in batches:
            for part in in_slices(batch):
                toxic = part.column(2).to_numpy()
                hits: dict[str, list[int]] = {}
                for y, fs in zip(toxic.tolist(), features_of(part.column(1)), strict=True):
                    for f in fs:
                        hits.setdefault(f, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(hits), pa.string()), pa.array([v[0] for v in hits.values()], pa.int64()), pa.array([v[1] for v in hits.values()], pa.int64())], names=["f", "n0", "n1"]
                )

    counted = train.select("doc_id", "text", "toxic").mapInArrow(count, "f string, n0 long, n1 long")
    counted = counted.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST)
    share = totals[1] / (totals[0] + totals[1])
    n, n1, n0 = F.col("n0") + F.col("n1"), F.col("n1"), F.col("n0")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(n1, F.lit(share)) + term(n0, F.lit(1 - share)))))
    best = counted.withColumn("apart", apart).where(F.col("apart") >= STANDS_OUT)
    # Identity terms are features too: the swapped copies hold their weights down.
    names = {r.f for r in best.orderBy(F.desc("apart"), "f").limit(FEATURES).select("f").collect()} | set(TERMS)
    wanted = {f: i for i, f in enumerate(sorted(names))}

    def rows(batches):
        for batch in batches:
            for part in in_slices(batch):
                swaps = [features_of(pa.array(copies, pa.string()), wanted) for copies in swapped_texts(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array(features_of(part.column(1), wanted), pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["toxic", "own", "swaps"]
                )

    # A row for each of the at most 2 * sample ids.
    got = train.select("doc_id", "text", "toxic").mapInArrow(rows, "toxic int, own array<int>, swaps array<array<int>>").collect()
    pairs = [(r.own, s) for r in got for s in r.swaps]
    weights = fit_logits([r.own for r in got], np.array([r.toxic for r in got], float), pairs, len(wanted))
    return wanted, weights


def score(docs: DataFrame, model: tuple[dict[str, int], np.ndarray] | None, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= TOXIC)."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    at = own.index(text)
    wanted, weights = model or ({}, np.array([-50.0]))

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, at):
                found = features_of(part.column(at), wanted)
                z = np.array([weights[fs].sum() if fs else 0.0 for fs in found]) + weights[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= TOXIC).astype(np.int32))], names=[*own, "score", "predicted"])

    return docs.select(*own).mapInArrow(run, docs.select(*own).schema.add("score", "double").add("predicted", "integer"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
