"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are those of the decontamination scan, shingles five words. A template of ``m`` shingles is looked
for in windows of the largest power of two up to ``m``, in documents a quarter of a window apart, in
templates at every place. Bands of two rows each make it very likely (see :func:`chance`) that a
window which shares half its shingles with a template's is retrieved; a match must then contain 80 in
100 of the template's shingles within a stretch of its length. Windows without any shingle of any
template share no band, so only those around such a shingle are looked at, in parts of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import annotate, documents
from .decontaminate import words
from .near_dup import _mix

SHINGLE = 5
BANDS, ROWS = 16, 2
PERCENT = 80
#: Shingles whose windows are hashed at once.
PART = 1 << 14
#: Notices by which texts name their license, openings of license texts, and whole ones.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause third clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def chance(similarity: float) -> float:
    """That windows of this similarity share a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def shingles(text: str | None) -> np.ndarray:
    """Hashed shingles in order, repeats included."""
    found = words(text)
    n = len(found) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    run = hashed[:n]
    for i in range(1, SHINGLE):
        run = _mix(run) + hashed[i : i + n]
    return _mix(run)


def band_keys(found: np.ndarray, sizes: list[int], step: bool):
    """For each window size: (window starts, keys by band and window). One shingle is its own key."""
    out = {1: (np.arange(len(found)), found[None, :])} if 1 in sizes else {}
    if max(sizes) > 1 and len(found) > 1:
        least = np.stack([_mix(found + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) for j in range(BANDS * ROWS)])
        size = 1
        while size * 2 <= max(sizes) and size * 2 <= len(found):
            least = np.minimum(least[:, :-size], least[:, size:])
            size *= 2
            if size in sizes:
                at = np.arange(0, least.shape[1], max(1, size // 4) if step else 1)
                picked = least[:, at].reshape(BANDS, ROWS, len(at))
                key = picked[:, 0]
                for r in range(1, ROWS):
                    key = _mix(key) + picked[:, r]
                out[size] = (at, key)
    return out


@dataclass
class Index:
    """The templates' shingles, and by window size the sorted band keys with their templates."""

    names: list[str]
    sets: list[np.ndarray]
    keys: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    every: np.ndarray

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        names, sets, keys = [], [], {}
        for name, text in templates.items():
            found = shingles(text)
            if not len(found):
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            size = 1 << (len(found).bit_length() - 1)
            for band, row in enumerate(band_keys(found, [size], False)[size][1]):
                keys.setdefault(size, {}).setdefault(band, []).extend((int(k), len(names)) for k in row)
            names.append(name)
            sets.append(np.unique(found))
        packed = {}
        for size, bands in keys.items():
            packed[size] = [(np.array([k for k, _ in rows], np.uint64), np.array([t for _, t in rows])) for rows in (sorted(set(bands[b])) for b in sorted(bands))]
        return cls(names, sets, packed, np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64))

    def parts(self, found: np.ndarray):
        """(start, end) of what the windows around a template's shingle cover, in parts of some PART shingles that overlap by a window."""
        if not len(self.every) or not len(found):
            return
        reach = max(self.keys)
        places = np.flatnonzero(self.every[np.minimum(np.searchsorted(self.every, found), len(self.every) - 1)] == found)
        breaks = np.flatnonzero(np.diff(places) > 2 * reach)
        for first, last in zip(places[[0, *(breaks + 1)]] if len(places) else (), places[[*breaks, -1]] if len(places) else ()):
            start, end = max(0, int(first) - reach), min(len(found), int(last) + reach + 1)
            for at in range(start, end, PART):
                yield at, min(end, at + PART + reach)

    def candidates(self, found: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, window start, window size) that share a band."""
        out = set()
        for start, end in self.parts(found):
            for size, (at, keys) in band_keys(found[start:end], list(self.keys), True).items():
                for (held, which), row in zip(self.keys[size], keys):
                    place = np.searchsorted(held, row)
                    for i in np.flatnonzero(held[np.minimum(place, len(held) - 1)] == row):
                        p = place[i]
                        while p < len(held) and held[p] == row[i]:
                            out.add((int(which[p]), start + int(at[i]), size))
                            p += 1
        return out

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment), without overlap within a template."""
        found = shingles(text)
        out: list[tuple[str, int, int, float]] = []
        last: dict[int, int] = {}
        for t, at, size in sorted(self.candidates(found)) if len(found) else ():
            goal = self.sets[t]
            if at + size <= last.get(t, -1):
                continue
            begin = max(0, at - len(goal), last.get(t, 0))
            hits = begin + np.flatnonzero(np.isin(found[begin : at + size + len(goal)], goal))
            best = (0, 0, 0)
            for i, a in enumerate(hits):
                inside = hits[i:][hits[i:] < a + -(-len(goal) * 5 // 4)]
                n = len(np.unique(found[inside]))
                if n > best[0]:
                    best = (n, int(a), int(inside[-1]))
            if 100 * best[0] >= PERCENT * len(goal):
                out.append((self.names[t], best[1], best[2] + SHINGLE, best[0] / len(goal)))
                last[t] = best[2] + 1
        # near-equal templates: what lies nearly whole within a better match is that one
        inside = lambda m, o: 5 * (min(m[2], o[2]) - max(m[1], o[1])) >= 4 * (m[2] - m[1])
        return [m for m in out if not any(o[3] > m[3] and inside(m, o) and 5 * (m[2] - m[1]) >= 4 * (o[2] - o[1]) for o in out)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, start_word, end_word, containment), empty without a match.

    ``templates`` is a dictionary in the driver's memory, sent to all tasks. Null and empty texts have
    no match, an empty table or no templates give none; repeated rows match alike; a text of any length
    is hashed in parts. Each template is looked for by itself, so one that holds another is reported
    beside it, but of matches of much the same words the one of most containment stays; matches of one
    template don't overlap, the first in the text counts. A column named licenses gives way.
    """
    one = StructType().add("license", StringType()).add("start_word", LongType()).add("end_word", LongType()).add("containment", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(templates))
    find = lambda text: ([dict(zip(one.names, m)) for m in shared.value.matches(text)],)
    return annotate(docs, text, StructType().add("licenses", ArrayType(one)), lambda: find, keep)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, a row for each."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.inline("licenses"))


QUERIES = {"op7_licenses": op7_licenses}
