"""Words of many texts at once, as distinct words and codes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at once.
CHARS = 1_000_000
#: A longer run of letters is cut into words of this length.
LONGEST = 64


@functools.cache
def _trim():
    """malloc_trim of the C library, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def released() -> None:
    """Gives freed memory back to the system: workers wait for the next task with what they hold."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def in_slices(batch: pa.RecordBatch, column: int = 1, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about so many bytes; a longer text is a part of its own."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    group = np.cumsum(sizes) // chars
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
    for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
        yield batch.slice(int(a), int(b - a))
    released()


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, codes of all words in order, end of each text): lower-case runs of letters and marks."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    low = pc.replace_substring_regex(low, rf"([^ ]{{{LONGEST}}})", r"\1 ")
    lists = pc.split_pattern(low, " ")
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.empty(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return coded.dictionary, codes[real], before[ends]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows of values over the ranges that end at ends."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    starts = np.concatenate([[0], ends[:-1]])
    return run[ends] - run[starts]
