"""License scans by patience alignment of texts with license templates.

Of all words of a text, those that a template has are looked at. Where enough of them stand close together, each word
counted as often as the template has it at most, the stretch is aligned with the template: words that are unique in both
are anchors, of which the longest increasing subsequence stays, and the gaps between anchors are aligned likewise. Coverage
is the share of the template's words that are matched in order.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyframe.llm._common import ALNUM_SEPARATOR, small_batches, table, text_chunks, words

# Public license notices and texts, as their owners word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely""",
    "all-rights-reserved": "All rights reserved",
}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of words of ``a`` and ``b`` that are matched in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        if not pairs:
            out += _aligned_gap(a, b, a0, a1, b0, b1)
            continue
        i0, j0 = a0, b0
        for i, j in _increasing(pairs):
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second places, by patience sorting."""
    tops: list[int] = []
    on: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        if k == len(tops):
            tops.append(j)
            on.append(n)
        else:
            tops[k], on[k] = j, n
        back[n] = on[k - 1] if k else -1
    out, n = [], on[-1]
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _aligned_gap(a, b, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """A gap without anchors, no longer than a stretch: the plain longest common subsequence of the words in both."""
    both = set(a[a0:a1]) & set(b[b0:b1])
    p, q = [i for i in range(a0, a1) if a[i] in both], [j for j in range(b0, b1) if b[j] in both]
    best = [[0] * (len(q) + 1)]
    for i in reversed(p):
        below, row = best[-1], [0] * (len(q) + 1)
        for j in range(len(q) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[q[j]] else max(below[j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if a[p[i]] == b[q[j]]:
            out.append((p[i], q[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _template_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM_SEPARATOR)[3]


#: What a word of the text costs that stands unmatched within an occurrence.
STRAY = 0.5


def _width(m: int) -> int:
    return m + m // 2 + 2


def best_stretch(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the matched pairs, those in a row that are most, less STRAY for each word of the text between them; the first such."""
    best, begin, total, found = 0.0, 0, 0.0, (0, 0)
    for k, (i, _) in enumerate(pairs):
        total += 1 - STRAY * (i - pairs[k - 1][0] - 1) if k else 1
        if total < 1:
            begin, total = k, 1.0
        if total > best:
            best, found = total, (begin, k + 1)
    return pairs[found[0] : found[1]]


def occurrence(text: list[int], template: list[int], need: int) -> tuple[int, int, int] | None:
    """``(first word, word behind the last, words matched)`` of the template in a stretch of text, or None.

    As much text as the template has words is aligned, then what follows with the rest of the template; so an occurrence
    does not reach into the next one for words that it lacks.
    """
    m = len(template)
    pairs = best_stretch(patience(text[:m], template))
    if pairs and pairs[-1][1] + 1 < m:
        i, j = pairs[-1][0] + 1, pairs[-1][1] + 1
        rest = patience(text[i : _width(m)], template[j:])
        pairs = best_stretch(pairs + [(i + x, j + y) for x, y in rest])
    return (pairs[0][0], pairs[-1][0] + 1, len(pairs)) if len(pairs) >= need else None


def _dense(at: np.ndarray, word: np.ndarray, last: np.ndarray, times: np.ndarray, m: int, need: int) -> np.ndarray:
    """Which of the places ``at``, that hold words of the template, begin a stretch with ``need`` words of it or more.

    A word counts as often as the template has it: where it does so ``times`` before in the stretch, it adds nothing.
    """
    order = np.lexsort((at, word))
    w, p = word[order], at[order]
    number = np.arange(len(w)) - np.searchsorted(w, w)
    back = np.full(len(w), -1)
    has = np.flatnonzero(number >= times[w])
    back[has] = p[has - times[w[has]]]
    since = np.empty(len(w), np.int64)
    since[order] = back
    # a word counts for all stretches that begin behind its last spare place and reach to it
    k = np.arange(len(at))
    first = np.searchsorted(at, np.maximum(since + 1, at - _width(m) + 1))
    inside = np.searchsorted(last, last[k])  # not beyond the row's first hit
    first = np.maximum(first, inside)
    count = np.zeros(len(at) + 1, np.int64)
    np.add.at(count, first, 1)
    np.add.at(count, k + 1, -1)
    return np.cumsum(count[:-1]) >= need


def find_template(name: np.ndarray, row: np.ndarray, template: np.ndarray, threshold: float, hits: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """``(first word, word behind the last, coverage)`` of the template's occurrences among a chunk's words.

    ``hits``: places that hold words of the template, if known.
    """
    m = len(template)
    need = math.ceil(threshold * m)
    vocabulary, times = np.unique(template, return_counts=True)
    if hits is None:
        hits = np.flatnonzero(np.isin(name, vocabulary))
    if len(hits) < need:
        return []
    last = np.searchsorted(row, row[hits], "right")
    dense = _dense(hits, np.searchsorted(vocabulary, name[hits]), last, times, m, need)
    out, b, done = [], template.tolist(), -1
    for i, end in zip(hits[dense].tolist(), last[dense].tolist(), strict=True):
        if i >= done and (found := occurrence(name[i : min(i + _width(m), end)].tolist(), b, need)):
            out.append((i + found[0], i + found[1], found[2] / m))
            done = i + found[1]
    return out


class _Templates:
    """The words of all templates, numbered together, so that a text's words are looked up once."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.known = known
        self.vocabulary = np.unique(np.concatenate([*known.values(), np.zeros(0, np.uint64)]))
        self.has = {k: np.isin(self.vocabulary, t) for k, t in known.items()}

    def find(self, name: np.ndarray, row: np.ndarray, threshold: float) -> list[tuple[str, int, int, float]]:
        place = np.minimum(np.searchsorted(self.vocabulary, name), max(len(self.vocabulary) - 1, 0))
        some = np.flatnonzero(self.vocabulary[place] == name) if len(self.vocabulary) else place[:0]
        place = place[some]
        return [(k, *x) for k, t in self.known.items() for x in find_template(name, row, t, threshold, some[self.has[k][place]])]


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``(key, license, start, end, coverage)``: one row per occurrence of a template in a text; no shuffle.

    ``start`` and ``end`` are numbers of words (runs of ASCII letters and digits and characters beyond ASCII, A-Z
    lower-cased). An occurrence begins and ends with a matched word, spans one and a half times the template's words at
    most, and matches ``threshold`` of them at least. Occurrences are taken from the left; those of one template do not
    overlap, different templates may.

    * null and empty texts and texts without a word: no rows. Repeated rows are reported repeatedly, null keys as null.
    * templates are the caller's and small; one without a word is refused. Very long texts are scanned whole.
    * an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    known = {k: _template_words(v) for k, v in templates.items()}
    if empty := [k for k, v in known.items() if not len(v)]:
        raise ValueError(f"templates without a word: {empty}")
    kind = docs.schema[key].dataType.simpleString()
    all_known = _Templates(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                _, _, row, name = words(data, offsets, ALNUM_SEPARATOR)
                first = np.searchsorted(row, np.arange(j - i))
                found = all_known.find(name, row, threshold)
                rows = np.array([row[x[1]] for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows + i)),
                        pa.array([x[0] for x in found], pa.string()),
                        pa.array([x[1] - int(first[r]) for x, r in zip(found, rows, strict=True)], pa.int64()),
                        pa.array([x[2] - int(first[r]) for x, r in zip(found, rows, strict=True)], pa.int64()),
                        pa.array([x[3] for x in found], pa.float64()),
                    ],
                    ["key", "license", "start", "end", "coverage"],
                )

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, license string, start long, end long, coverage double").withColumnRenamed("key", key)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
