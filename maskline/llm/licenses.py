"""License scans: winnowed fingerprints of templates pick candidates, banded alignment says what matches and where.

Templates are few and fixed, so their index is of fixed size and travels with the function: the hashes of `gram` words,
the smallest of every `winnow` neighbours, with the places where they stand; both less where the coverage asked for lets
so many words be changed or left out that no longer run need stay. Each document is probed with all its grams, in one pass
without a shuffle, so a notice with words changed or left out, but not put in, is a candidate if enough of it stays. One
with words put in is if a run of a template's gram stays. Hits of a template that lie near one diagonal are a candidate;
its stretch of the document and the template are aligned in a band around it, so shifts of more than the band (8 words, and
less than half the template) can cost matches.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskline.llm.anchors import hashes, ladder
from maskline.llm.common import id_and_text, slices, utf8
from maskline.llm.words import FIXED, LOWER, Words, key

# Notices as their licenses ask for them to be given, in short and longer form.
TEMPLATES = {
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License.",
    "MIT short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.",
    "All rights reserved": "All rights reserved.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
    "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
    "Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General "
    "Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work.",
}

# Whole license texts.
_WITHOUT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WHOLE = {
    "MIT whole": f"{TEMPLATES['MIT']} {_WITHOUT_WARRANTY}",
    "BSD-2-Clause whole": f"{TEMPLATES['BSD-2-Clause']} {_BSD_WARRANTY}",
    "BSD-3-Clause whole": f"{TEMPLATES['BSD-2-Clause']} Neither the name of the copyright holder nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior written "
    f"permission. {_BSD_WARRANTY}",
    "ISC whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE.",
    "Zlib whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
    "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
    "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0 whole": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
    'software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom "
    "the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
    "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
    "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
    "works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS "
    'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
    "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense whole": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
    f"copyright law. {_WITHOUT_WARRANTY}",
}
TEMPLATES |= WHOLE

#: Bytes of a word: letters, digits and whatever isn't ASCII.
WORD = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])
FIELDS = [
    ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()),
    ("template_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
]
DDL = "doc_id bigint, license string, coverage double, matched_words bigint, template_words bigint, start bigint, end bigint"


def words_of(data: np.ndarray, starts: np.ndarray, key: tuple[int, int] = FIXED) -> Words:
    return Words(LOWER[data], starts, WORD, key)


def grams_of(words: Words, gram: int) -> np.ndarray:
    """A hash for each word and the following ones; 0 where they run over the end of the text."""
    if not len(words.hash):
        return words.hash
    found = hashes(ladder(words.hash, gram), gram)
    left = np.repeat(words.of_doc[1:], np.diff(words.of_doc)) - np.arange(len(found))
    return np.where(left >= gram, found, 0)


def fingerprint(length: int, gram: int, winnow: int, coverage: float) -> tuple[int, int]:
    """(gram, winnow) of a template: as given, or less where words may be changed or left out so that no longer run stays.

    With m words gone the others stand in m + 1 runs at most; each gram of the longest is wanted, and one word is the least."""
    gone = length - math.ceil(coverage * length)
    run = -(-(length - gone) // (gone + 1))
    own = max(1, min(gram, run))
    return own, max(1, min(winnow, run - own + 1))


class Index:
    """Inverted index of the winnowed fingerprints of templates (name: text), by length of gram."""

    def __init__(self, templates: dict[str, str], gram: int, winnow: int, coverage: float, key: tuple[int, int] = FIXED):
        self.names, self.words, self.key = list(templates), [], key
        places: dict[int, set[tuple[int, int, int]]] = {}
        for number, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            words = words_of(data, np.array([0, len(data)]), key)
            self.words.append(words.hash)
            if len(words.hash) < gram:
                raise ValueError(f"a template needs {gram} words: {self.names[number]}")
            size, window = fingerprint(len(words.hash), gram, winnow, coverage)
            found = grams_of(words, size)[: len(words.hash) - size + 1]
            for a in range(max(1, len(found) - window + 1)):
                some = found[a : a + window]
                place = a + len(some) - 1 - int(np.argmin(some[::-1]))  # the last of equal ones
                places.setdefault(size, set()).add((int(found[place]), number, place))
        self.entries = {}
        for size, own in places.items():
            grams, numbers, at = zip(*sorted(own), strict=True)
            self.entries[size] = np.array(grams, np.uint64), np.array(numbers, np.int64), np.array(at, np.int64)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in words, template, place in the template) of all fingerprints among the grams of words, in order of place."""
        found = [(np.zeros(0, np.int64),) * 3]
        for size, (own, template, inside) in self.entries.items():
            grams = grams_of(words, size)
            low, high = np.searchsorted(own, grams), np.searchsorted(own, grams, side="right")
            at = np.flatnonzero(high > low)
            n = (high - low)[at]
            entry = np.repeat(low[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(at, n), template[entry], inside[entry]))
        place, template, inside = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], template[order], inside[order]


def candidates(place: np.ndarray, inside: np.ndarray, length: int, band: int) -> list[tuple[int, int, int]]:
    """(diagonal, first, last place) for each run of hits of one template in one document, in order of place. A hit goes to
    the last run that began of those within reach; runs that are out of reach by place are not looked at again."""
    found: list[list[int]] = []
    near: list[list[int]] = []
    for p, i in zip(place.tolist(), inside.tolist(), strict=True):
        near = [run for run in near if p - run[2] <= length]
        for run in reversed(near):
            if abs(p - i - run[0]) <= band:
                run[2] = p
                break
        else:
            found.append([p - i, p, p])
            near.append(found[-1])
    return [tuple(run) for run in found]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first and last + 1 place in text) of the best local alignment: template word i meets a text word
    within `band` places of i + diagonal. A match is worth 2, a word left out or put in, or another one, costs 1."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # text place: score, matches, first place
    for i, word in enumerate(template.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)):
            score, matches, first = above.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matches, first = 0, 0, j
            if word == text[j]:
                cell = (score + 2, matches + 1, first)
            else:
                cell = (score - 1, matches, first)
            for other in (above.get(j), row.get(j - 1)):
                if other is not None and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                if word == text[j] and (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1:]


def reach(length: int, band: int) -> int:
    """The band of a template: less than half of it, so that one copy's does not reach the next one's."""
    return min(band, (length - 1) // 2)


def places(
    template: np.ndarray, text: np.ndarray, found: list[tuple[int, int, int]], band: int, coverage: float
) -> Iterator[tuple[int, int, int]]:
    """(matched words, first and last + 1 place) of the candidates found, best first, none over another. What a place leaves
    of a candidate's band to its left and right, and what another place leaves of it, is aligned again."""
    least, open_ = coverage * len(template), []
    # Places that are taken don't overlap: begins and ends, both in order, and how many were taken before.
    begins: list[int] = []
    ends: list[tuple[int, int]] = []

    def look(a: int, b: int, diagonal: int) -> None:
        if b - a >= least:
            matched, begin, end = align(template, text[a:b], diagonal - a, band)
            if matched and matched >= least:
                heapq.heappush(open_, (-matched, a + begin, a + end, a, b, diagonal))

    for diagonal in dict.fromkeys(d for d, _, _ in found):
        look(max(0, diagonal - band), min(len(text), diagonal + len(template) + band), diagonal)
    while open_:
        matched, begin, end, a, b, diagonal = heapq.heappop(open_)
        # Of those that it lies over, the first that was taken.
        low, high = bisect.bisect_right(ends, begin, key=lambda e: e[0]), bisect.bisect_left(begins, end)
        if low < high:
            k = min(range(low, high), key=lambda i: ends[i][1])
            over = begins[k], ends[k][0]
        else:
            over = begin, end
            begins.insert(low, begin)
            ends.insert(low, (end, len(ends)))
            yield -matched, begin, end
        look(a, min(b, over[0]), diagonal)
        look(max(a, over[1]), b, diagonal)


def license_spans(
    docs: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, winnow: int = 4, band: int = 8, coverage: float = 0.75
) -> DataFrame:
    """(doc_id, license, coverage, matched_words, template_words, start, end) for docs (doc_id, text).

    One row for each place where at least `coverage` of a template's words match in order; start and end are character
    places in the text. Words are compared without case and signs. Of overlapping places of one template the one with more
    matches is told, of equal ones the first. A null or empty text has none; rows that repeat an id are scanned each;
    other columns are ignored. Templates need `gram` words at least.
    """
    index = Index(TEMPLATES if templates is None else templates, gram, winnow, coverage, key())

    def spans(words: np.ndarray, place: np.ndarray, template: np.ndarray, inside: np.ndarray) -> Iterator[tuple]:
        for number in np.unique(template).tolist():
            own, mine = index.words[number], template == number
            for matched, begin, end in places(own, words, candidates(place[mine], inside[mine], len(own), reach(len(own), band)), reach(len(own), band), coverage):
                yield number, matched, len(own), begin, end

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(FIELDS)
        for part in slices(parts):
            data, starts = utf8(part["text"])
            words = words_of(data, starts, index.key)
            place, template, inside = index.hits(words)
            doc = np.searchsorted(words.of_doc, place, side="right") - 1
            ids, rows = part["doc_id"].to_pylist(), []
            for k in np.unique(doc).tolist():
                own, at = doc == k, int(words.of_doc[k])
                hashed = words.hash[at : words.of_doc[k + 1]]
                for number, matched, length, begin, end in spans(hashed, place[own] - at, template[own], inside[own]):
                    a, b = int(words.start[at + begin]), int(words.end[at + end - 1])
                    start = len(data[starts[k] : a].tobytes().decode())
                    rows.append(
                        {
                            "doc_id": ids[k], "license": index.names[number], "coverage": matched / length, "matched_words": matched,
                            "template_words": length, "start": start, "end": start + len(data[a:b].tobytes().decode()),
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return id_and_text(docs).mapInArrow(scan, DDL)
