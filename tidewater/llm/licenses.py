r"""Op 1. License scans by patience alignment.

Words are runs of 0-9, A-Z, a-z and non-ASCII characters, A-Z folded. A template matches where ``COVERAGE`` of its words are aligned
in order with a window of the text. An alignment anchors on words that are unique to both sides, keeps the longest
increasing run of them, and does the gaps between them again; equal words at a gap's ends are taken as well.

Windows come from seeds: of a template of n words, at most the share 1 - ``COVERAGE`` may be missing, so of any more words than
that one is there. The least common ones are the seeds; each place where one stands gives a window. No text is too long and
no match is missed by the search for windows. Matches of one template do not overlap (the better one stays), and of
overlapping matches of several the one with more words aligned stays.

Null and empty texts match nothing. Rows are scanned one by one, without a shuffle; repeated rows give repeated results, an empty
table gives none. The work on a long text is n log n in its matches and linear in its words. Only doc_id and text are
read, so further columns, whatever their names, do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.textkit import byte_values, hash_words

COVERAGE = 0.8

#: Public license texts and notices.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.""",
    "CC0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
}
#: Words that are common in texts of any kind, and so are the last to be seeds.
COMMON = frozenset("a all an and any as at be by can for from in is it may mit no not of on or other the this to under use version with you 0 1 2 3 4".split())


def separators() -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[:128] = [not chr(b).isalnum() for b in range(128)]
    return mask


def align(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned places, both increasing."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        anchors = _longest(_unique(template, a, b, text, c, d))
        pairs += anchors
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo += ((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m)
    return sorted(pairs)


def _unique(template: list[int], a: int, b: int, text: list[int], c: int, d: int) -> list[tuple[int, int]]:
    once: dict[int, int] = {}
    for i in range(a, b):
        once[template[i]] = -1 if template[i] in once else i
    there: dict[int, int] = {}
    for j in range(c, d):
        if once.get(text[j], -1) >= 0:
            there[text[j]] = -1 if text[j] in there else j
    return sorted((once[w], j) for w, j in there.items() if j >= 0)


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run that increases in both places, by patience piles."""
    tops: list[int] = []
    top_pair: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(top_pair[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_pair.append(n)
        else:
            tops[pile], top_pair[pile] = j, n
    run: list[tuple[int, int]] = []
    at = top_pair[-1] if top_pair else -1
    while at >= 0:
        run.append(pairs[at])
        at = back[at]
    return run[::-1]


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[int, ...]
    seeds: tuple[tuple[int, int], ...]  #: (hash, place)
    known: frozenset[int]
    need: int  #: words to be aligned
    slack: int  #: words that a window has more on each side


@lru_cache(maxsize=4)
def compiled(coverage: float = COVERAGE) -> tuple[tuple[Template, ...], np.ndarray, dict[int, tuple[tuple[int, int], ...]]]:
    """Templates; sorted seed hashes; (template, place) of each seed."""
    values, mask = byte_values(fold_case=True), separators()
    made, places = [], {}
    for t, (name, text) in enumerate(TEMPLATES.items()):
        found = hash_words([text.encode()], mask, values)
        spelled = [found.word(i).decode().lower() for i in range(len(found.hashes))]
        n = len(spelled)
        need = int(np.ceil(coverage * n))
        order = sorted(range(n), key=lambda i: (spelled[i] in COMMON, -len(spelled[i]), spelled[i], i))
        seeds = tuple((int(found.hashes[i]), i) for i in order[: n - need + 1])
        made.append(Template(name, tuple(found.hashes.tolist()), seeds, frozenset(found.hashes.tolist()), need, max(2, n - need)))
        for h, place in seeds:
            places.setdefault(h, []).append((t, place))
    return tuple(made), np.array(sorted(places), np.uint64), {h: tuple(p) for h, p in places.items()}


Match = tuple[int, int, int, int]  #: template, first word, end, words aligned


def matches(words: list[int], hits: list[int], coverage: float = COVERAGE) -> list[Match]:
    """Matches in one text, in order, from the places of its seed words."""
    templates, _, places = compiled(coverage)
    windows = set()
    for at in hits:
        for t, place in places[words[at]]:
            one = templates[t]
            windows.add((t, max(at - place - one.slack, 0), min(at - place + len(one.words) + one.slack, len(words))))
    found = set()
    for t, low, high in windows:
        one = templates[t]
        window = words[low:high]
        if sum(w in one.known for w in window) < one.need:
            continue
        pairs = align(list(one.words), window)
        if len(pairs) >= one.need:
            found.add((t, low + pairs[0][1], low + pairs[-1][1] + 1, len(pairs)))
    begins: list[int] = []  # of the matches kept, which overlap nowhere
    kept: list[Match] = []
    for m in sorted(found, key=lambda m: (-m[3], m[2] - m[1], m)):
        i = bisect_left(begins, m[1])
        if (not i or kept[i - 1][2] <= m[1]) and (i == len(kept) or m[2] <= kept[i][1]):
            begins.insert(i, m[1])
            kept.insert(i, m)
    return kept


def scan(texts: list[bytes | None], coverage: float = COVERAGE) -> Iterator[tuple[int, list[tuple[str, float, int, int]]]]:
    """For each text: its words, and (template, coverage, start, end) of its matches, in bytes."""
    templates, seeds, _ = compiled(coverage)
    words = hash_words(texts, separators(), byte_values(fold_case=True))
    place = np.searchsorted(seeds, words.hashes)
    hits = np.flatnonzero(seeds[np.minimum(place, len(seeds) - 1)] == words.hashes)
    cuts = np.searchsorted(hits, words.bounds)
    base = 0
    for i, text in enumerate(texts):
        a, b = int(words.bounds[i]), int(words.bounds[i + 1])
        found = []
        if cuts[i] < cuts[i + 1]:
            for t, low, high, n in matches(words.hashes[a:b].tolist(), (hits[cuts[i] : cuts[i + 1]] - a).tolist(), coverage):
                found.append((templates[t].name, n / len(templates[t].words), int(words.starts[a + low]) - base, int(words.ends[a + high - 1]) - base))
        yield b - a, found
        base += len(text or b"") + 1


def _points(text: bytes | None, at: list[int]) -> dict[int, int]:
    """Code points before each place of a text in bytes, in one pass."""
    raw, points, n, last = np.frombuffer(text or b"", np.uint8), {}, 0, 0
    for i in sorted(set(at)):
        n += int(np.count_nonzero((raw[last:i] & 0xC0) != 0x80))
        last = i
        points[i] = n
    return points


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for text, (n, found) in zip(texts, scan(texts)):
            points = _points(text, [i for f in found for i in f[2:4]])
            spans = ",".join(f"{f[0]}:{points[f[2]]}:{points[f[3]]}" for f in found)
            row = (n, len(found), ",".join(sorted({f[0] for f in found})), max((f[1] for f in found), default=0.0), spans)
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], ["doc_id", "n_words", "n_licenses", "licenses", "coverage", "spans"])


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its matches, as code points of the text, and the best coverage."""
    rows = docs.select("doc_id", docs["text"].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_digests, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_licenses long, licenses string, coverage double, spans string")
