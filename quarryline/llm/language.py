"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, found by a forward pass; a text's is the product over its
words. The probabilities are learned by expectation maximisation (forward-backward) on the word counts
of a bounded sample: all words of about SAMPLE documents a language.

A word is a run of letters and marks, lower-cased; runs over 64 letters are cut. Characters outside the vocabulary
are pieces of a small fixed probability.

Defined cases: a text that is null or has no letter is `und` with score 0, as are all texts where no labelled
document exists; a null doc_id is not held out; repeated rows are predicted alike; very long texts are taken whole; columns of the names
given for the results are replaced, others stay; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import in_slices, letter_words, sums

UND = "und"
SAMPLE, ROUNDS = 2000, 5
#: Each character of a word scales its probability by exp(SCALE), so that long words stay in range.
SCALE = 3.5
#: Log probability of a character that is no piece, and what every piece's count gets more.
UNKNOWN, MORE = -12.0, 0.05
#: Words whose segmentations are summed at once, and words whose results a task keeps.
AT_ONCE, CACHE = 10_000, 400_000
BASE = np.uint64(1_099_511_628_211)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of code points laid end to end."""
    out = np.zeros(len(codes) + 1, np.uint64)
    # h[i + 1] = h[i] + codes[i] * BASE ** i; compared after shifting to a common power.
    out[1:] = np.cumsum(codes.astype(np.uint64) * _powers(len(codes)))
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), BASE, np.uint64)]))[:n]


def _inverse_powers(n: int) -> np.ndarray:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), inverse, np.uint64)]))[:n]


class Pieces:
    """The lower-case letter pieces of a vocabulary, found in words by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.names = sorted(p for p in names if p == p.lower() and all(c.isalpha() or c == "▁" for c in p) and "▁" not in p[1:])
        self.longest = max(map(len, self.names))
        own = np.array([self._hash(p) for p in self.names], np.uint64)
        self.order = np.argsort(own)
        self.sorted = own[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        return sum(ord(c) * pow(int(BASE), i, 2**64) for i, c in enumerate(piece)) % 2**64

    def lattice(self, words: list[str]) -> dict:
        """Pieces in every word: from and to (positions), piece (len(names): unknown character), grouped by depth."""
        text = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), "<u4")
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        first = np.cumsum(size) - size
        depth = np.arange(len(text)) - np.repeat(first, size)
        left = np.repeat(size, size) - depth
        h, back = _hashes(text), _inverse_powers(len(text))
        found = []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            key = (h[at + n] - h[at]) * back[at]
            where = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            hit = self.sorted[where] == key
            piece = np.where(hit, self.order[where], len(self.names))
            if n > 1:
                at, piece = at[hit], piece[hit]
            found.append((at, np.full(len(at), n), piece))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # A word of size n has n + 1 positions: position i of word w is first[w] + w + i.
        shift = np.repeat(np.arange(len(words)), size)[start]
        frm = start + shift
        to = frm + length
        end = depth[start] + length
        order = np.lexsort((to, end))
        frm, to, piece, end, length = frm[order], to[order], piece[order], end[order], length[order]
        return {
            "from": frm, "to": to, "piece": piece, "length": length, "steps": np.flatnonzero(np.append(True, end[1:] != end[:-1])),
            "first": first + np.arange(len(words)), "last": first + np.arange(len(words)) + size, "n": len(text) + len(words), "begin": depth[start][order],
        }


def _gains(lattice: dict, p: np.ndarray) -> np.ndarray:
    return p[lattice["piece"]] * np.exp(SCALE * lattice["length"])[:, None]


def forward(lattice: dict, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scaled forward sums at every position, gains of every arc); p: probability of piece by language."""
    gain = _gains(lattice, p)
    alpha = np.zeros((lattice["n"], p.shape[1]))
    alpha[lattice["first"]] = 1.0
    steps = np.append(lattice["steps"], len(lattice["to"]))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        to = lattice["to"][a:b]
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        alpha[to[cut]] = np.add.reduceat(alpha[lattice["from"][a:b]] * gain[a:b], cut, axis=0)
    return alpha, gain


def expected(lattice: dict, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece by language; counts: of every word by language."""
    alpha, gain = forward(lattice, p)
    beta = np.zeros_like(alpha)
    beta[lattice["last"]] = counts / np.maximum(alpha[lattice["last"]], 1e-290)
    order = np.lexsort((lattice["from"], -lattice["begin"]))
    frm, to, begin = lattice["from"][order], lattice["to"][order], lattice["begin"][order]
    steps = np.append(np.flatnonzero(np.append(True, begin[1:] != begin[:-1])), len(frm))
    own = gain[order]
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        cut = np.flatnonzero(np.append(True, frm[a:b][1:] != frm[a:b][:-1]))
        beta[frm[a:b][cut]] = np.add.reduceat(beta[to[a:b]] * own[a:b], cut, axis=0)
    uses = alpha[lattice["from"]] * gain * beta[lattice["to"]]
    return np.stack([np.bincount(lattice["piece"], uses[:, k], minlength=p.shape[0]) for k in range(p.shape[1])], axis=1)


def learn(pieces: Pieces, seen: list[tuple[list[str], np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Probability of every piece (the last: an unknown character) by language; seen: the words of each and their counts.

    Languages are learned one by one and AT_ONCE words at a time, so memory doesn't grow with the words.
    """
    p = np.full((len(pieces.names) + 1, len(seen)), 1.0 / len(pieces.names))
    p[-1] = np.exp(UNKNOWN)
    for k, (words, counts) in enumerate(seen):
        own = p[:, k : k + 1]
        for _ in range(rounds if words else 0):
            uses = np.full((len(pieces.names), 1), MORE)
            for a in range(0, len(words), AT_ONCE):
                uses += expected(pieces.lattice(words[a : a + AT_ONCE]), own, counts[a : a + AT_ONCE, None])[:-1]
            own[:-1] = uses / uses.sum(axis=0)
    return p


class Known:
    """Log probabilities of words by language; those of the last CACHE words or so are kept by hash."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.keys, self.values = np.empty(0, np.uint64), np.empty((0, p.shape[1]))

    def _fresh(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.p.shape[1]))
        for a in range(0, len(words), AT_ONCE):
            lattice = self.pieces.lattice(words[a : a + AT_ONCE])
            alpha, _ = forward(lattice, self.p)
            out[a : a + AT_ONCE] = np.log(np.maximum(alpha[lattice["last"]], 1e-300))
        return out

    def logs(self, words: list[str]) -> np.ndarray:
        import xxhash

        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        old = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        out = np.empty((len(words), self.p.shape[1]))
        out[old] = self.values[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = self._fresh([words[i] for i in new.tolist()])
            full = len(self.keys) + len(new) > CACHE
            keys = own if full else np.concatenate([self.keys, own[new]])
            values = out if full else np.concatenate([self.values, out[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return out


def _split(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    return _split(doc_id) == 1


def fit(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities) from the rows of docs (doc_id, text, lang) that are not held out."""
    train = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    totals = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return [], np.zeros((0, 0))
    share = F.lit(0)
    for name in names:
        share = F.when(F.col("lang") == name, int(1e6 * min(1.0, sample / totals[name]))).otherwise(share)
    some = train.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) < share)

    def count(batches):
        for batch in batches:
            for part in in_slices(batch):
                own, codes, ends = letter_words(part.column(1))
                lang = part.column(2).dictionary_encode()
                of = np.repeat(lang.indices.to_numpy(), np.diff(ends, prepend=0))
                key, n = np.unique(of.astype(np.int64) * max(1, len(own)) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(key // max(1, len(own)))).cast(pa.string()), own.take(pa.array(key % max(1, len(own)))).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"]
                )

    found = some.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = found.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    seen = []
    for name in names:
        own = found.filter(pc.equal(found["lang"], name))
        seen.append((own["word"].to_pylist(), own["n"].to_numpy().astype(float)))
    return names, learn(Pieces(path or vocabulary_path()), seen)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the columns out: the likeliest language and its posterior under equal priors; columns of these names are replaced."""
    names, p = model
    path = path or vocabulary_path()
    own = [c for c in docs.columns if c not in out]
    at = own.index(text)

    def run(batches):
        known = Known(Pieces(path), p) if names else None
        for batch in batches:
            for part in in_slices(batch, at):
                words, codes, ends = letter_words(part.column(at))
                best, score = np.full(part.num_rows, len(names)), np.zeros(part.num_rows)
                if names and len(codes):
                    used, codes = np.unique(codes, return_inverse=True)
                    total = sums(known.logs(words.take(pa.array(used)).to_pylist())[codes], ends)
                    some = np.diff(ends, prepend=0) > 0
                    total -= total.max(axis=1, keepdims=True)
                    post = np.exp(total)
                    post /= post.sum(axis=1, keepdims=True)
                    best[some] = post.argmax(axis=1)[some]
                    score[some] = np.clip(post.max(axis=1), 0.0, 1.0)[some]
                pred = pa.array([*names, UND]).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(score)], names=[*own, *out])

    schema = docs.select(*own).schema.add(out[0], "string").add(out[1], "double")
    return docs.select(*own).mapInArrow(run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
