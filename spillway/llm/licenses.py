"""Operator 10, license scans: patience alignment of texts with license templates.

Template and text are word sequences (lower-case words, as everywhere here). The
alignment anchors on words that occur once in both, takes the longest increasing
subsequence of the anchors, and aligns every gap between anchors in the same
way, after stripping what the gap's two sides have in common at their ends. Coverage is the
share of the template's words that are aligned, within the part of the text that the first and
last aligned words span plus what the template lacks.

A text is aligned with a template only if it holds at least THRESHOLD of the template's words
(each as often as in the template, which coverage cannot exceed). These bounds
are counted with numpy for all texts and templates at once. The
text is cut at its places richest in template words: windows around every rarest template
word are aligned, so words that are frequent elsewhere in a long text do no harm. One window can hold
the template wherever the word is in it (twice its length to each side). Copies of a license that
follow each other repeat all its words there, so two more kinds are aligned: between the word's occurrences before and
after, and of the template's length from where it would begin.

Templates are broadcast; they are the built-in list or a parameter. Those of more than LIMIT characters are taken
in groups, each with its own pass over the documents.

Defined cases. A null or empty text holds no license. A template without words is left out. Several
licenses in a text give a row each; of several places of one, the best (the first among equals) counts.
A template listed twice gives a row for each listing. Repeated rows give repeated results; very long texts are scanned whole. doc_id may be null or of any type. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, read, words

THRESHOLD = 0.8
LIMIT = 4 << 20  # characters of templates that are broadcast at once
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = [
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("GPL-2.0-header", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("LGPL-2.1-header", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles with back pointers)."""
    tops, piles, back = [], [], []
    for i, x in enumerate(seq):
        p = bisect_left(tops, x)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[p], piles[p] = x, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j), increasing in both, of two sequences."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {b[j]: j for j in range(j0, j1) if cb[b[j]] == 1}
        unique = [(i, place[a[i]]) for i in range(i0, i1) if ca[a[i]] == 1 and a[i] in place]
        if not unique:
            continue
        chain = [unique[k] for k in increasing([j for _, j in unique])]
        out += chain
        for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *chain], [*chain, (i1, j1)]):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


class Library:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.names, self.words, need = [], [], []
        for name, text in templates:
            h, _, _, _ = words(pa.array([text]))
            if len(h):
                self.names.append(name)
                self.words.append(h.tolist())
                need.append(np.unique(h, return_counts=True))
        self.threshold = threshold
        self.vocabulary = np.unique(np.concatenate([k for k, _ in need] or [np.zeros(0, np.uint64)]))
        self.need = np.zeros((len(need), len(self.vocabulary)), np.int64)
        for i, (k, c) in enumerate(need):
            self.need[i, np.searchsorted(self.vocabulary, k)] = c
        self.total = self.need.sum(1)
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, template, coverage, first word, last word)."""
        if not len(self.vocabulary):
            return []
        hashes, rows, _, _ = words(column)
        at = np.flatnonzero(self.known[(hashes >> np.uint64(48)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[code] == hashes[at]
        at, code = at[hit], code[hit]
        size = len(self.vocabulary)
        keys, n = np.unique(rows[at] * size + code, return_counts=True)
        some, local = np.unique(keys // size, return_inverse=True)
        held = np.zeros((len(some), size), np.int64)
        held[local, keys % size] = n
        bounds = np.searchsorted(rows, np.arange(len(column) + 1))
        out = []
        for t, need in enumerate(self.need):
            cols = np.flatnonzero(need)
            share = np.minimum(held[:, cols], need[cols]).sum(1) / self.total[t]
            for r in np.flatnonzero(share >= self.threshold - 1e-9):
                row = int(some[r])
                found = self.place(hashes[bounds[row] : bounds[row + 1]], t, held[r])
                if found:
                    out.append((row, t, *found))
        return sorted(out)

    def place(self, text: np.ndarray, t: int, held: np.ndarray) -> tuple[float, int, int] | None:
        """The best alignment over windows around the occurrences of the template's rarest words."""
        template = self.words[t]
        m = len(template)
        best: tuple[float, int, int] | None = None
        # an alignment that reaches the threshold has `enough` words and lacks the others at most,
        # so one of so many and one more of the rarest must lie in it
        enough = int(np.ceil(self.threshold * m - 1e-9))
        lacking = m - enough + 1
        cols = np.flatnonzero(self.need[t])
        order = cols[np.argsort(held[cols], kind="stable")]
        cum = np.cumsum(self.need[t][order])
        seeds = self.vocabulary[order[: int(np.searchsorted(cum, lacking)) + 1]]
        spots = np.flatnonzero(np.isin(text, seeds))
        within = {w: np.flatnonzero(np.array(template, np.uint64) == w) for w in seeds}
        places = {w: np.flatnonzero(text == w) for w in seeds}
        known = np.append(0, np.cumsum(np.isin(text, np.array(template, np.uint64))))
        windows: set[tuple[int, int]] = set()
        last = -m - 1
        for s in spots.tolist():
            at, near = within[text[s]], places[text[s]]
            k, times = int(np.searchsorted(near, s)), len(at)
            if s - last > m:  # else the window before holds whatever lies around this word
                last = s
                windows.add((s - 2 * m, s + 2 * m))
            # as many occurrences as the template has, this one the first, and none beyond them
            before = int(near[k - 1]) + 1 if k else 0
            after = int(near[k + times]) if k + times < len(near) else len(text)
            windows.add((max(before, s - 2 * m), min(after, s + 2 * m)))
            windows.update((s - p, s - p + m) for p in at.tolist())
        for lo, hi in sorted({(max(0, lo), min(len(text), hi)) for lo, hi in windows}):
            if known[hi] - known[lo] < enough:
                continue
            window = text[lo:hi]
            aligned = patience(template, window.tolist())
            # keep the densest run: the template's matches must lie within twice its length
            js = [j for _, j in aligned]
            a = 0
            for b in range(len(js)):
                while js[b] - js[a] >= 2 * m:
                    a += 1
                coverage = (b - a + 1) / m
                found = (coverage, lo + js[a], lo + js[b])
                if b - a + 1 >= enough and (best is None or (-coverage, *found[1:]) < (-best[0], *best[1:])):
                    best = found
        return best


def groups(templates: list[tuple[str, str]], limit: int) -> list[list[tuple[str, str]]]:
    """The templates in order, in groups of at most ``limit`` characters or one template."""
    out, size = [[]], 0
    for t in templates:
        if out[-1] and size + len(t[1]) > limit:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t[1])
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word) for each license that a document holds."""
    kind, out = docs.schema["doc_id"].dataType.simpleString(), None
    for group in groups(templates, limit):
        shared = docs.sparkSession.sparkContext.broadcast(Library(group, threshold))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            library = shared.value
            for batch in batches:
                for part in chunks(batch):
                    found = library.scan(part.column("text"))
                    ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([library.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                        ["doc_id", "license", "coverage", "first_word", "last_word"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, first_word bigint, last_word bigint")
        out = part if out is None else out.unionByName(part)
    return out


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
