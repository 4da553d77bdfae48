"""Byte-pair encoding of many texts at once.

Texts are cut at ASCII white space; the distinct pieces of a batch that hold only plain Latin
characters and no apostrophe are cut into words where the class of characters changes, and their
distinct words are merged together with numpy arrays, one column a word; other pieces and long words go
through the tokenizer itself. Both give the tokenizer's ids.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose case, class and normal form are the same everywhere; "<|" may start a special token, an apostrophe a contraction.
PLAIN = r"^[!-&(-;=-~¡-¬®-ÿŒœŠšŽžŸ‘’“”„–—…€]*$"
#: Bytes of the words that are merged together, by groups of similar length.
WIDTHS = (4, 8, 12, 16, 24)
#: Slots of the table of merges are 2 ** SLOT_BITS; its multiplier.
SLOT_BITS, SPREAD = 20, np.uint64(0x9E3779B97F4A7C15)
#: The rank of a pair that doesn't merge.
NEVER = np.int32(1 << 30)
LETTER, DIGIT, OTHER = 0, 1, 2
CLASSES = np.array([{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x2100)], np.int8)


def byte_letters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Ragged:
    """Arrays of ids laid end to end."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        self.ids, self.ends = ids, ends
        self.sizes = np.diff(ends, prepend=0)

    def take(self, codes: np.ndarray) -> Ragged:
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat((self.ends - self.sizes)[codes] - (ends - sizes), sizes)
        return Ragged(self.ids[at], ends)

    def grouped(self, ends: np.ndarray) -> Ragged:
        """The arrays up to each of ends joined."""
        return Ragged(self.ids, np.concatenate([[0], self.ends])[ends])


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        keys = left * self.size + np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.ranks]
        # A slot holds one merge; slots that several share are looked up among the sorted keys.
        slot = self._slot(self.keys)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, NEVER, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = self.keys, self.ranks
        self.shared = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        letters = byte_letters()
        # Numbers of a byte inside a word and at its end.
        self.byte = np.array([[vocab[c], vocab[c + end]] for c in letters], np.int32)
        flat = self.byte.astype(np.int64)
        self.first = self.rank_of(flat[:, 0][:, None, None], flat[None, :, :])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs of ids; NEVER where there is none or an id is negative."""
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        rank = np.where(self.slot_key[slot] == key, self.slot_rank[slot], NEVER)
        unsure = self.shared[slot]
        if unsure.any():
            own = key[unsure]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            rank[unsure] = np.where(self.keys[at] == own, self.ranks[at], NEVER)
        return np.where((left >= 0) & (right >= 0), rank, NEVER)

    def _merged(self, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        """Ids of words of at most width bytes as rows, -1 behind their end."""
        n = len(begin)
        ids, rank = np.full((width + 1, n), -1, np.int32), np.full((width + 1, n), NEVER, np.int32)
        before = None
        for j in range(width):
            on = np.flatnonzero(sizes > j)
            byte, last = raw[begin[on] + j], (sizes[on] == j + 1).astype(np.int8)
            ids[j, on] = self.byte[byte, last]
            if j:
                rank[j - 1, on] = self.first[before[on], byte, last]
            before = np.zeros(n, np.uint8) if before is None else before
            before[on] = byte
        out, column = np.full((width, n), -1, np.int32), np.arange(n)
        # Every merge makes a word one id shorter, so fewer rows are in use each time.
        for used in range(width, 0, -1):
            low = rank[:used].min(axis=0)
            done = np.flatnonzero(low == NEVER)
            if len(done):
                out[:used, column[done]] = ids[:used].take(done, axis=1)
                going = np.flatnonzero(low < NEVER)
                column, low = column[going], low[going]
                ids, rank = ids[: used + 1].take(going, axis=1), rank[: used + 1].take(going, axis=1)
            if not len(column):
                break
            # The first pair of the lowest rank merges, what follows it moves up.
            at = np.zeros(len(column), np.int8)
            for j in range(used - 1, -1, -1):
                np.copyto(at, j, where=rank[j] == low)
            for j in range(used):
                behind = at < j
                np.copyto(ids[j], ids[j + 1], where=behind)
                np.copyto(rank[j], rank[j + 1], where=behind)
            every, place = np.arange(len(column)), at.astype(np.int64)
            new = self.merged[low]
            ids[place, every] = new
            rank[place, every] = self.rank_of(new, ids[place + 1, every])
            inner = np.flatnonzero(place)
            rank[place[inner] - 1, inner] = self.rank_of(ids[place[inner] - 1, inner], new[inner])
        return out.T

    def words(self, words: pa.Array) -> Ragged:
        """Ids of distinct lower-case words, each one piece of the tokenizer's split."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        parts, which = [], []
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(own):
                found = self._merged(raw, offsets[:-1][own], sizes[own], width)
                parts.append(Ragged(found[found >= 0].astype(np.uint32), np.cumsum((found >= 0).sum(axis=1))))
                which.append(own)
            low = width
        own = np.flatnonzero((sizes > low) | (sizes == 0))
        if len(own):
            parts.append(self._direct(words.take(pa.array(own)).to_pylist()))
            which.append(own)
        return _joined(parts, which, n)

    def _direct(self, pieces: list[str]) -> Ragged:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return Ragged(np.concatenate(found) if found else np.empty(0, np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64))

    def _plain(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces of plain characters."""
        low = pc.utf8_lower(pieces)
        n = len(low)
        offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + n + 1]
        data = (low.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        points = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), "<u4")
        kind = CLASSES[points]
        starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        new = np.zeros(len(data) + 1, bool)
        new[offsets - offsets[0]] = True
        new[starts[(kind == DIGIT) | np.append(True, kind[1:] != kind[:-1])]] = True
        cuts = np.flatnonzero(new).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), data])
        coded = words.dictionary_encode()
        ends = np.searchsorted(cuts, offsets[1:] - offsets[0])
        return self.words(coded.dictionary).take(coded.indices.to_numpy()).grouped(ends)

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces without white space."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        if plain.all():
            return self._plain(pieces)
        other = self._direct(pieces.filter(pa.array(~plain)).to_pylist())
        return _joined([self._plain(pieces.filter(pa.array(plain))), other], [np.flatnonzero(plain), np.flatnonzero(~plain)], len(pieces))

    def texts(self, texts: pa.Array) -> Ragged:
        """Ids of every text; nulls are empty."""
        lists = pc.split_pattern(_spaced(pc.fill_null(texts, "")), " ")
        coded = lists.values.dictionary_encode()
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        return self._pieces(coded.dictionary).take(coded.indices.to_numpy()).grouped(ends)


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> WordBpe:
    """The encoder of a file; a worker keeps the last one, a few MB, for its next tasks."""
    return WordBpe(path)


def _joined(parts: list[Ragged], which: list[np.ndarray], n: int) -> Ragged:
    """The arrays of parts in the order of their numbers, which are those below n."""
    place, base, ends, shift = np.empty(n, np.int64), 0, [], 0
    for part, own in zip(parts, which, strict=True):
        place[own] = base + np.arange(len(own))
        ends.append(part.ends + shift)
        base, shift = base + len(own), shift + len(part.ids)
    if not parts:
        return Ragged(np.empty(0, np.uint32), np.zeros(n, np.int64))
    return Ragged(np.concatenate([p.ids for p in parts]), np.concatenate(ends)).take(place)


def _spaced(texts: pa.Array) -> pa.Array:
    """texts with ASCII control white space as spaces."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    raw[(raw >= 9) & (raw <= 13)] = 32
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(raw)])
