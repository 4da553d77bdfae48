"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words and winnowed: of every WINDOW successive hashes of GRAM words the
smallest is kept in an inverted index from hash to (template, position). A text's hashes that hit the index
are grouped by diagonal (position in the text less position in the template), and each group within a band
is aligned with its template word by word inside that band. What covers COVERAGE of a template is reported with
the span of the text from its first to its last matched word; these words match the template no more, and the group's other hits are
aligned again until too few are left.

Defined cases: null and empty texts match nothing; a text may hold several matches, also of one template, and words that two templates share
count for both; very long texts are scanned whole; repeated rows match alike; a null doc_id stays null; an empty table gives an empty
result; other columns are not read and may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table
from ._words import in_slices

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 12, 0.8
#: Share of a template's fingerprints, at least one, that a group of hits needs before it is aligned.
HITS = 0.25
#: Where hits of a template repeat, what a word of text inside a match costs that isn't matched, so that no match takes words of the next copy.
SKIP = 0.5
_U = np.uint64

# Public license notices.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors "
    "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
    "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
    "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
    "domain.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of '
    "the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
    "it and redistribute it freely.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(_LOWER))


_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(word_hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of every n successive words."""
    out = np.zeros(max(0, len(word_hashes) - n + 1), np.uint64)
    for k in range(n):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + word_hashes[k : k + len(out)])
    return out


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the smallest hash of every window, the last of equals."""
    if len(hashes) <= window:
        return [int(len(hashes) - 1 - hashes[::-1].argmin())] if len(hashes) else []
    out = []
    for a in range(len(hashes) - window + 1):
        at = a + window - 1 - int(hashes[a : a + window][::-1].argmin())
        if not out or out[-1] != at:
            out.append(at)
    return out


def aligned(template: list[str], text: list[str], shift: int, band: int = BAND, skip: float = 0.0) -> tuple[int, int, int]:
    """(matched words, first, last matched word of text) of the best alignment with text[i + shift - band .. + band] for template[i].

    Every word of text between the first and the last that isn't matched costs skip matches.
    """
    width = 2 * band + 1
    best = np.zeros(width)
    steps = np.zeros((len(template), width), np.int8)
    top = (0.0, 0, 0)
    for i, word in enumerate(template):
        at = i + shift - band
        new = np.zeros(width)
        for k in range(width):
            j = at + k
            skip_template = best[k + 1] if k + 1 < width else -1
            skip_text = new[k - 1] - skip if k else -1
            hit = best[k] + 1 if 0 <= j < len(text) and text[j] == word else best[k] - skip
            new[k], steps[i, k] = max((hit, 0), (skip_template, 1), (skip_text, 2), key=lambda s: s[0])
            if new[k] < 0:
                new[k], steps[i, k] = 0.0, 3
            if new[k] > top[0]:
                top = (new[k], i, k)
        best = new
    i, k, rows = (top[1], top[2], []) if skip else (len(template) - 1, int(best.argmax()), [])
    while i >= 0 and 0 <= k < width:
        step = steps[i, k]
        if step == 0:
            j = i + shift - band + k
            if 0 <= j < len(text) and text[j] == template[i]:
                rows.append(j)
            i -= 1
        elif step == 1:
            i, k = i - 1, k + 1
        elif step == 2:
            k -= 1
        else:
            break
    return (len(rows), min(rows), max(rows)) if rows else (0, 0, 0)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.names, self.words = list(templates), [words_of(t) for t in templates.values()]
        index: dict[int, list[tuple[int, int]]] = {}
        self.prints = []
        with np.errstate(over="ignore"):
            for t, words in enumerate(self.words):
                own = grams(np.array([self.hash(w) for w in words], np.uint64))
                at = winnowed(own)
                self.prints.append(len(at))
                for p in at:
                    index.setdefault(int(own[p]), []).append((t, p))
        self.index, self.keys = index, np.sort(np.array(list(index), np.uint64))

    def hits(self, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """By text, (position, hash) of the hashes in the index."""
        low = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[^a-z0-9]+", " ")
        lists = pc.split_pattern(pc.ascii_trim(low, " "), " ")
        coded = lists.values.dictionary_encode()
        own = np.fromiter((self.hash(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        with np.errstate(over="ignore"):
            h = grams(own[coded.indices.to_numpy()]) if len(coded) else np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == h)
        of = np.searchsorted(ends, found, "right")
        out: dict[int, list[tuple[int, int]]] = {}
        starts = np.concatenate([[0], ends])
        for d, p in zip(of.tolist(), found.tolist(), strict=True):
            if p + GRAM <= ends[d]:
                out.setdefault(d, []).append((p - int(starts[d]), int(h[p])))
        return out

    def matches(self, text: str, hits: list[tuple[int, int]]) -> list[tuple]:
        """(license, start, end, matched, words, coverage) of a text with hits."""
        spots = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)]
        words = [text[a:b].translate(_LOWER) for a, b in spots]
        by: dict[int, list[tuple[int, int]]] = {}
        for p, h in hits:
            for t, q in self.index[h]:
                by.setdefault(t, []).append((p - q, q))
        out = []
        for t, seeds in by.items():
            seeds.sort()
            left, group, skips = list(words), [], (SKIP, 0.0) if len({q for _, q in seeds}) < len(seeds) else (0.0,)
            for s in [*seeds, (1 << 60, 0)]:
                if group and s[0] - group[0][0] > BAND:
                    out += [(self.names[t], spots[a][0], spots[b][1], n, len(self.words[t]), n / len(self.words[t])) for n, a, b in self._copies(t, left, group, skips)]
                    group = []
                group.append(s)
        return sorted(out, key=lambda m: (m[1], m[2], m[0]))

    def _copies(self, t: int, left: list[str], group: list[tuple[int, int]], skips: tuple) -> list[tuple[int, int, int]]:
        """(matched words, first, last) of every copy of template t that a group of (diagonal, position) holds; the words of copies are blanked in left."""
        out = []
        while len({q for _, q in group}) >= max(1, HITS * self.prints[t]):
            for skip in skips:
                n, a, b = aligned(self.words[t], left, group[len(group) // 2][0], skip=skip)
                if n >= COVERAGE * len(self.words[t]):
                    break
            if n < COVERAGE * len(self.words[t]):
                break
            out.append((n, a, b))
            left[a : b + 1] = [""] * (b + 1 - a)
            group = [(d, q) for d, q in group if all(left[d + q : d + q + GRAM])]
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, matched_words, template_words, coverage): a row for every match in docs (doc_id, text)."""

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            for part in in_slices(batch):
                rows = []
                for d, hits in scanner.hits(part.column(1)).items():
                    rows += [(part.column(0)[d].as_py(), *m) for m in scanner.matches(part.column(1)[d].as_py(), hits)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "license", "start", "end", "matched_words", "template_words", "coverage"])

    schema = "doc_id long, license string, start long, end long, matched_words long, template_words long, coverage double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
