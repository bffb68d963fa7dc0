"""License scans by patience alignment with license templates.

Words are runs of letters and digits (and of bytes outside ASCII), in lower case. For each template the words of a text that the
template has are clustered: two of them at most `gap` words apart, or half as many as the template has, lie in one cluster, so a
page's foot or a remark inside a notice does not part it. A cluster with too few of them to cover the template is left. Each remaining cluster is aligned with the template: words that occur once in both are anchors, the longest
increasing subsequence of them is kept, and the gaps between anchors are aligned in the same way; equal words next to an
anchor or to a gap's ends are matched at once. Coverage is the part of the template's words that are matched. A cluster in
which every word of the template comes more than once, as where a notice is repeated, is cut where its rarest word comes again.

Nulls, empties, ties: a null text, or one without words, has no licenses. Rows are scanned one by one, also repeated ones. Of templates
with equal coverage in a text the longer one is the best, then the first by name. Columns other than the id and the text are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.text import Texts, sliced, texts

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


@dataclass(frozen=True)
class Template:
    name: str
    text: str


#: Public license notices.
TEMPLATES = (
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    Template(
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    Template(
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS '
        'IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    Template(
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    Template(
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    Template(
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
    Template(
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    Template("CC0-1.0-line", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    Template("MIT-line", "Released under the MIT License."),
    Template("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    Template("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("BSD-3-Clause-line", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
)
#: Coverage from which a template is found, and words between two of its words at most, where half its length is less.
COVERAGE, GAP = 0.8, 6


def words(found: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, in lower case, and for each row the index of its first word."""
    low = found.lower()
    starts, ends, first = low.words(~_WORD_BYTE)
    return low.hashes(starts, ends), first


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of distinct values."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched positions (in text, in template), both ascending."""
    out, open_ = [], [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        own, other = Counter(text[a:b]), Counter(template[c:d])
        place = {text[i]: i for i in range(a, b) if own[text[i]] == 1}
        pairs = [(place[template[j]], j) for j in range(c, d) if other[template[j]] == 1 and template[j] in place]
        if not pairs:
            continue
        anchors = [pairs[k] for k in increasing([i for i, _ in pairs])]
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Templates as word hashes."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE, gap: int = GAP):
        self.templates, self.coverage, self.gap = templates, coverage, gap
        self.words = [words(texts(pa.array([t.text])))[0].tolist() for t in templates]
        self.known = [np.unique(np.array(w, np.uint64)) for w in self.words]
        self.need = [int(np.ceil(coverage * len(w) - 1e-9)) for w in self.words]
        self.reach = [max(gap, len(w) // 2) for w in self.words]

    def _best(self, text: list[int], k: int) -> tuple[float, int, int]:
        """Coverage, first and last matched word of a cluster, in parts where its words repeat."""
        template = self.words[k]
        n = Counter(text)
        there = [w for w in set(template) if n[w]]
        rarest = min(there, key=lambda w: (n[w], template.index(w)))
        if n[rarest] > 1:
            hits, before = [i for i, w in enumerate(text) if w == rarest], template.index(rarest) + self.reach[k]
            cuts = [0, *(max(lo + 1, hi - before) for lo, hi in zip(hits, hits[1:], strict=False)), len(text)]
        else:
            cuts = [0, len(text)]
        best = (0.0, 0, 0)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            pairs = align(text[lo:hi], template)
            if pairs and len(pairs) / len(template) > best[0]:
                best = (len(pairs) / len(template), lo + pairs[0][0], lo + pairs[-1][0])
        return best

    def scan(self, found: Texts) -> dict[int, list[tuple[str, float, int, int]]]:
        """By row, each template that is found: name, coverage, first word, number of words."""
        hashes, first = words(found)
        out: dict[int, list[tuple[str, float, int, int]]] = {}
        for k, known in enumerate(self.known):
            at = np.searchsorted(known, hashes)
            hits = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes)
            if not len(hits):
                continue
            row = np.searchsorted(first, hits, "right") - 1
            new = np.flatnonzero((np.diff(hits, prepend=-(10**9)) > self.reach[k] + 1) | (np.diff(row, prepend=-1) > 0))
            for lo, n in zip(new.tolist(), np.diff(np.append(new, len(hits))).tolist(), strict=True):
                if n < self.need[k]:
                    continue
                a, b, r = int(hits[lo]), int(hits[lo + n - 1]), int(row[lo])
                if len(np.unique(hashes[hits[lo : lo + n]])) < self.coverage * len(known) - (len(self.words[k]) - self.need[k]):
                    continue
                share, i, j = self._best(hashes[a : b + 1].tolist(), k)
                if share >= self.coverage:
                    out.setdefault(r, []).append((self.templates[k].name, share, int(a - first[r]) + i, j - i + 1))
        return out


_OUT = "doc_id long, licenses array<string>, license string, coverage double, first_word long, n_words long"


def _scan(scanner: Scanner) -> Callable:
    size = {t.name: len(w) for t, w in zip(scanner.templates, scanner.words, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in sliced(batch, "text"):
                hits = scanner.scan(found)
                all_ = [hits.get(i, []) for i in range(len(found))]
                best = [min(x, key=lambda y: (-y[1], -size[y[0]], y[0], y[2])) if x else (None, None, None, None) for x in all_]
                names = [sorted({y[0] for y in x}) for x in all_]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(names, pa.list_(pa.string())), *(pa.array([b[i] for b in best], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64())))],
                    names=["doc_id", "licenses", "license", "coverage", "first_word", "n_words"],
                )

    return run


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """doc_id, licenses (all found), license (the best), its coverage, and where it stands: first_word, n_words. Nulls where none is found."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(scanner or Scanner()), _OUT)
