"""License scan by patience alignment of words against license templates.

Words that occur once in both sides are anchors; the longest increasing subsequence of their places is kept, and the gaps
between neighbouring anchors are aligned in the same way (a gap without anchors by its equal ends). Coverage is the share of
a template's words that are aligned. Regions of a text that can reach the coverage are found first, without loss, by the
template's words within a window of twice its length. In a region the shortest stretch whose longest common subsequence with the template reaches
the coverage is aligned and extended on both sides, then the search goes on behind it, so copies may stand side by side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import ceil

from pyspark.sql import DataFrame

from hodoscope.llm.common import map_rows, once

COVERAGE = 0.8
WORD = re.compile(r"\w+")

#: Texts of common licenses, notices and statements.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT statement": "Released under the MIT License.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause statement": "Licensed under the BSD 3-Clause License.",
}


def words(text: str | None) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)] if text else []


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            pile.append(i)
        else:
            tops[k], pile[k] = p, i
        back.append(pile[k - 1] if k else -1)
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: pairs of places of equal words, rising in both."""
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
        if a0 >= a1 or b0 >= b1:
            continue
        at_a, at_b = _single(a, a0, a1), _single(b, b0, b1)
        both = sorted((at_a[w], at_b[w]) for w in at_a.keys() & at_b.keys())
        anchors = [both[i] for i in increasing([p for _, p in both])]
        if not anchors:
            continue
        out.extend(anchors)
        for (x, y), (u, v) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def _single(own: list[str], start: int, end: int) -> dict[str, int]:
    """Words that occur once in start..end, with their places."""
    seen: dict[str, int] = {}
    for i in range(start, end):
        seen[own[i]] = -1 if own[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.own = {n: [w for w, _, _ in words(t)] for n, t in templates.items()}
        self.sets = {n: frozenset(w) for n, w in self.own.items()}
        self.every = frozenset(w for s in self.sets.values() for w in s)
        self.counts = {n: Counter(w) for n, w in self.own.items()}
        self.bits = {n: (_bits(w), _bits(w[::-1])) for n, w in self.own.items()}
        self.order = sorted(self.own)


def regions(own: list[str], counts: Counter[str], size: int, need: int) -> list[tuple[int, int]]:
    """Stretches of own in which some window of 2 * size words has need words of the template, each as often as there at most.

    No alignment of need words within that length lies outside of them.
    """
    hits = [i for i, w in enumerate(own) if w in counts]
    seen, both, low, out = Counter(), 0, 0, []
    for at in hits:
        seen[own[at]] += 1
        both += seen[own[at]] <= counts[own[at]]
        while hits[low] <= at - 2 * size:
            w = own[hits[low]]
            both -= seen[w] <= counts[w]
            seen[w] -= 1
            low += 1
        if both >= need:
            if out and hits[low] <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((hits[low], at + 1))
    return out


def _bits(own: list[str]) -> dict[str, int]:
    """Places of each word, as the bits of a number."""
    out: dict[str, int] = {}
    for i, w in enumerate(own):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _reach(own: list[str], places: range, bits: dict[str, int], size: int, need: int) -> int:
    """The first of places up to which a template's longest common subsequence with own has need words; -1 if it never has."""
    full = left = (1 << size) - 1
    for i in places:
        at = left & bits.get(own[i], 0)
        if at:
            left = (left + at | left - at) & full
            if size - left.bit_count() >= need:
                return i
    return -1


def _trimmed(pairs: list[tuple[int, int]], edge: int, side: int) -> list[tuple[int, int]]:
    """Of pairs going away from edge, those worth the text skipped for them at half a word each."""
    score, best, keep = 0.0, 0.0, 0
    for i, (at, _) in enumerate(pairs):
        score += 1 - (abs(at - edge) - 1) / 2
        edge = at
        if score > best:
            best, keep = score, i + 1
    return pairs[:keep][::side]


def _extended(own: list[str], want: list[str], low: int, a: int, b: int, high: int) -> list[tuple[int, int]]:
    """Pairs of the alignment of own[a:b], extended into low..a and b..high by the words the template has left on that side."""
    core = [(a + x, y) for x, y in align(own[a:b], want)]
    if not core:
        return []
    (a, first), (b, last) = core[0], core[-1]
    low, high = max(low, a - 2 * first), min(high, b + 1 + 2 * (len(want) - last - 1))
    before = [(low + x, y) for x, y in align(own[low:a], want[:first])]
    after = [(b + 1 + x, last + 1 + y) for x, y in align(own[b + 1 : high], want[last + 1 :])]
    return _trimmed(before[::-1], a, -1) + core + _trimmed(after, b, 1)


def _need(size: int, coverage: float) -> int:
    """The fewest of a template's words that reach the coverage."""
    return max(1, ceil(coverage * size - 1e-9))


def copies(own: list[str], want: list[str], bits: tuple[dict[str, int], dict[str, int]], a: int, b: int, need: int) -> list[list[tuple[int, int]]]:
    """Alignments of at least need words within own[a:b] that do not overlap, from left to right."""
    size, out = len(want), []
    while a < b:
        high = min(b, a + 3 * size)
        end = _reach(own, range(a, high), bits[0], size, need)
        if end < 0:
            a += size  # a stretch of twice the template's length that starts before would lie in a..high
            continue
        start = _reach(own, range(end, a - 1, -1), bits[1], size, need)
        best: list[tuple[int, int]] = []
        if end - start < 2 * size:
            best = _densest(_extended(own, want, a, start, end + 1, b), size)
            if len(best) < need:
                low = max(a, start - size // 4)
                best = _densest([(low + x, y) for x, y in align(own[low : min(b, end + 1 + size // 4)], want)], size)
        if len(best) >= need:
            out.append(best)
            a = best[-1][0] + 1
        else:
            a = start + 1
    return out


def scan(text: str | None, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of templates covered in a text, by start; of overlapping finds the longest alignment stays."""
    if not text:
        return []
    known = Templates(templates) if templates else once("license templates", lambda: Templates(TEMPLATES))
    bag = known.every.intersection(WORD.findall(text.lower()))
    needs = {n: _need(len(known.own[n]), coverage) for n in known.order}
    tries = [n for n in known.order if sum(map(known.counts[n].__getitem__, known.sets[n] & bag)) >= needs[n]]
    if not tries:
        return []
    own = words(text)
    plain = [w for w, _, _ in own]
    found = []
    for name in tries:
        want = known.own[name]
        for a, b in regions(plain, known.counts[name], len(want), needs[name]):
            for pairs in copies(plain, want, known.bits[name], a, b, needs[name]):
                found.append((len(pairs), name, len(pairs) / len(want), own[pairs[0][0]][1], own[pairs[-1][0]][2]))
    out: list[tuple[int, int, str, float]] = []  # by start; none overlap, so only the neighbours can be in a new one's way
    for _, name, share, start, end in sorted(found, key=lambda f: (-f[0], f[3], f[1])):
        at = bisect_left(out, (start,))
        if (not at or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
            out.insert(at, (start, end, name, share))
    return [(name, share, start, end) for start, end, name, share in out]


def _densest(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The most aligned pairs that lie within twice the template's length of text."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= 2 * size:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return pairs[best[0] : best[1]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses, coverage for every row of docs; licenses: name:start:end by start, comma-joined.

    coverage is that of the best find (0 without one). A null or empty text has none; repeated rows give repeated results;
    extra columns are ignored.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [scan(t, templates) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "n_licenses": [len(f) for f in found],
            "licenses": [",".join(f"{n}:{s}:{e}" for n, _, s, e in f) for f in found],
            "coverage": [max((c for _, c, _, _ in f), default=0.0) for f in found],
        }

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_licenses long, licenses string, coverage double")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
