"""License scanning by patience alignment.

A template (a notice or a whole license) is compared with a text by anchoring on the words
that are unique to both, keeping the longest increasing subsequence of these anchors, and
aligning the gaps between two anchors in the same way; where a gap has no unique common
word, equal words at its ends are matched. Coverage is the share of the template's words
that found a partner. What is aligned are the places, of at most twice the template's
length, that share enough words with it in order: the length of the longest common
subsequence bounds any alignment. Places of one template don't overlap; those that end
first are taken, so a notice that is repeated is found each time. Where patience is misled
by words that aren't unique, the bound itself is the coverage.

Null and empty texts have no license. Rows that repeat are scanned each. doc_id may be null. Of
licenses that begin at one place the surer one comes first, then the lesser name; a text may
be covered by several templates at once. An empty table gives no rows; other columns aren't
read. A text is held whole, its words as objects; the work is linear in it for each template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import by_batch

# Public license texts, their paragraphs where these also stand alone, notices and identifiers.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "spdx MIT": "SPDX-License-Identifier: MIT",
    "spdx Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx ISC": "SPDX-License-Identifier: ISC",
    "spdx MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "spdx LGPL-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx AGPL-3.0-only": "SPDX-License-Identifier: AGPL-3.0-only",
}

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their places in the text."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ordered by the first) whose second rises."""
    tails, ends, before = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[k], ends[k] = y, i
        before.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        chain = rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        if not chain:
            continue
        low = (a0, b0)
        for i, j in [*chain, (a1, b1)]:
            stack.append((low[0], i, low[1], j))
            low = (i + 1, j + 1)
        out += chain
    return sorted(out)


def common(hits: list[int], mask: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Each of the places `hits` with the longest common subsequence of the template and the words up to there.

    mask: for each place, the bits of the template's places with the same word.
    """
    full = (1 << size) - 1
    state = full
    for i, m in zip(hits, mask, strict=True):
        both = state & m
        state = (state + both | state - both) & full
        yield i, size - state.bit_count()


class Template:
    def __init__(self, own: list[str]):
        self.words, self.size, self.number = own, len(own), Counter(own)
        self.bits = {w: sum(1 << i for i, x in enumerate(own) if x == w) for w in self.number}
        self.back = {w: sum(1 << i for i, x in enumerate(own[::-1]) if x == w) for w in self.number}

    def need(self, least: float) -> int:
        """The fewest words that cover enough."""
        return next((n for n in range(1, self.size) if n / self.size >= least), self.size)

    def ahead(self, own: list[str], hits: list[int]) -> Iterator[tuple[int, int]]:
        return common(hits, [self.bits[own[i]] for i in hits], self.size)

    def behind(self, own: list[str], hits: list[int]) -> Iterator[tuple[int, int]]:
        return common(hits[::-1], [self.back[own[i]] for i in hits[::-1]], self.size)

    def cores(self, own: list[str], hits: list[int], need: int) -> list[tuple[int, int]]:
        """First and last of the places in `hits`, by number, of disjoint shortest spans that cover enough, by their ends.

        hits: the places of the template's words.
        """
        found, have, shared, low, ready = [], Counter(), 0, 0, 0
        for k, i in enumerate(hits):
            w = own[i]
            have[w] += 1
            shared += have[w] <= self.number[w]
            while hits[low] <= i - 2 * self.size:
                w = own[hits[low]]
                have[w] -= 1
                shared -= have[w] < self.number[w]
                low += 1
            if shared < need or k < ready:
                continue
            *_, (_, most) = self.ahead(own, hits[low : k + 1])
            if most < need:
                # a word more adds one at most
                ready = k + need - most
                continue
            first = next(k - n for n, (_, most) in enumerate(self.behind(own, hits[low : k + 1])) if most == need)
            found.append((first, k))
            have.clear()
            shared, low = 0, k + 1
        return found

    def places(self, own: list[str], least: float) -> list[tuple[float, int, int]]:
        """Coverage, first and last word of each place that covers enough."""
        need, hits = self.need(least), [i for i, w in enumerate(own) if w in self.number]
        cores = self.cores(own, hits, need)
        found, after = [], 0
        for at, (first, last) in enumerate(cores):
            # what the template has besides, up to the next place and back to the one before
            stop = cores[at + 1][0] if at + 1 < len(cores) else len(hits)
            stop = min(stop, bisect_left(hits, hits[first] + 2 * self.size))
            end, _ = max(self.ahead(own, hits[first:stop]), key=lambda x: x[1])
            last = bisect_left(hits, end)
            begin, most = max(self.behind(own, hits[max(after, bisect_left(hits, end + 1 - 2 * self.size)) : last + 1]), key=lambda x: x[1])
            after = last + 1
            aligned = len(align(self.words, own[begin : end + 1]))
            found.append(((aligned if aligned >= need else most) / self.size, begin, end))
        return found


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.templates = {name: Template(words(t)[0]) for name, t in templates.items()}
        self.kinds = {w for t in self.templates.values() for w in t.number}

    def scan(self, text: str | None, least: float = 0.8) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in code points) of every place that covers enough of a template."""
        if not text:
            return []
        kinds = {w.lower() for w in set(_WORD.findall(text))} & self.kinds
        # no place can share more words than the whole text does
        some = {name: t for name, t in self.templates.items() if sum(map(t.number.__getitem__, kinds & t.number.keys())) >= t.need(least)}
        if not some:
            return []
        own, spans = words(text)
        found = [(name, share, spans[a][0], spans[b][1]) for name, t in some.items() for share, a, b in t.places(own, least)]
        found.sort(key=lambda f: (f[2], -f[1], f[0]))
        return found


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and `licenses` (license, coverage, start, end) of each row of docs: one pass, no shuffle."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [[dict(zip(("license", "coverage", "start", "end"), f, strict=True)) for f in scanner.scan(t, least)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "licenses"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(source, run, "doc_id long, licenses array<struct<license: string, coverage: double, start: long, end: long>>")
