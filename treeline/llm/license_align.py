"""License scans by patience alignment.

Text and template become lists of normalised words (lower case; a version as 2 for 2.0 and v2). Words that stand once in both are anchors; the
longest increasing subsequence of their places fixes an alignment; the gaps between anchors are aligned in the same way, and equal words at a
gap's ends are matched first. Coverage is the part of the template's words that are aligned. A match needs THRESHOLD of the template's words within
twice its length (five quarters of it for short ones), and every word that tells the license from its relatives (`must`: the version, `by-nc`, `lesser`, `neither` and the like),
so that the notice of another version or variant is no match, however alike; a license without a template of its own gives none.

A notice is a small part of a document and may stand in it more than once, so that a template is aligned with windows rather than with whole
texts: windows of three lengths at every length, wherever telling words (those outside COMMON) are dense enough, and windows of the template's own
length from wherever a quarter of its telling words stand in their places, since copies side by side leave no word single in a wide window.
What has been aligned is taken out of the text and the rest is aligned again, until nothing more is found. Of matches of different templates that
share most of their words the better one stays, so that a notice inside a longer text isn't reported beside it.

Scale: a map over rows; a text without a template's must-words costs one pass over its words, whatever its length. No shuffle.

Defined results: null, empty and blank texts have no license; ties in coverage go to the longer template, then to the smaller name, then to the
earlier place; rows that repeat an id get a result each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import with_small_batches

WORD = re.compile(r"\w+(?:[.\-]\w+)*")
VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)?")
THRESHOLD = 0.8
#: Templates with fewer words are looked for within five quarters of their length, others within twice.
SHORT = 20


@dataclass(frozen=True)
class Template:
    name: str
    license: str
    text: str
    must: tuple[str, ...]


# Notices and texts as their licenses give them.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
APACHE_HEADER = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
CC0_WAIVER = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
UNLICENSE_OPENING = "This is free and unencumbered software released into the public domain."

# The families of licenses whose notices differ in names and versions only.
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CREATIVE_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("3.0",))}
APACHE_VERSIONS = ("1.0", "1.1", "2.0")
# Words too common to tell a license.
COMMON = frozenset("a all an and any are as at be by for from if in is it of on one or that the this to with you your not under work file".split())


def families() -> Iterator[Template]:
    for v in APACHE_VERSIONS:
        yield Template(f"Apache-{v}", f"Apache-{v}", f"Licensed under the Apache License, Version {v}", ("apache", v))
    for kind, words in CREATIVE_COMMONS.items():
        for v in CREATIVE_COMMONS_VERSIONS:
            name = f"CC-{kind}-{v}"
            yield Template(f"{name}-short", name, f"Licensed under CC {kind} {v}", ("cc", kind, v))
            yield Template(name, name, f"This work is licensed under a Creative Commons {words} {v} International License", ("creative", "commons", words, v))
    for short, (words, versions) in GNU.items():
        for v in versions:
            name, must = f"{short}-{v}", (*words.split()[:-1], v)
            yield Template(name, name, f"This work is licensed under the {words}, version {v}", must)
            yield Template(
                f"{name}-or-later", f"{name}-or-later",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
                (*must, "later"),
            )


TEMPLATES = (
    *families(),
    Template("Apache-2.0-header", "Apache-2.0", APACHE_HEADER, ("apache", "2.0")),
    Template("MIT", "MIT", "Released under the MIT License", ("mit",)),
    Template("MIT-grant", "MIT", MIT_GRANT, ("permission", "sublicense", "merge")),
    Template("MIT-text", "MIT", f"{MIT_GRANT} {MIT_WARRANTY}", ("permission", "sublicense", "merge", "noninfringement")),
    Template("BSD-2-Clause", "BSD-2-Clause", f"{BSD_OPENING} {BSD_WARRANTY}", ("redistribution", "binary", "disclaimer")),
    Template("BSD-3-Clause", "BSD-3-Clause", f"{BSD_OPENING} {BSD_THIRD} {BSD_WARRANTY}", ("redistribution", "binary", "neither", "endorse")),
    Template("BSD-3-Clause-conditions", "BSD-3-Clause", f"{BSD_OPENING} {BSD_THIRD}", ("redistribution", "binary", "neither", "endorse")),
    Template("ISC", "ISC", ISC_GRANT, ("permission", "purpose", "fee")),
    Template("MPL-2.0", "MPL-2.0", MPL_HEADER, ("mozilla", "2.0")),
    Template("CC0-1.0", "CC0-1.0", CC0_WAIVER, ("waived", "copyright")),
    Template("Unlicense", "Unlicense", UNLICENSE_OPENING, ("unencumbered", "public", "domain")),
    Template("Proprietary", "Proprietary", "All rights reserved", ("all", "rights", "reserved")),
)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [VERSION.fullmatch(w)[1] if w[-1].isdigit() and VERSION.fullmatch(w) else w for w in WORD.findall(text.lower())]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first places, a longest run with increasing second places, by patience sorting."""
    tops: list[int] = []
    piles: list[list[tuple[int, int, int]]] = []
    for a, b in pairs:
        p = bisect_left(tops, b)
        below = len(piles[p - 1]) - 1 if p else -1
        if p == len(piles):
            tops.append(b)
            piles.append([])
        tops[p] = b
        piles[p].append((a, b, below))
    out, at = [], len(piles[-1]) - 1 if piles else -1
    for pile in reversed(piles):
        a, b, below = pile[at]
        out.append((a, b))
        at = below
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The aligned places (in text, in template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        left = (a, c)
        for i, j in [*anchors, (b, d)]:
            if left[0] < i and left[1] < j:
                todo.append((left[0], i, left[1], j))
            left = (i + 1, j + 1)
    return sorted(out)


@dataclass(frozen=True)
class Match:
    template: str
    license: str
    coverage: float
    first: int
    end: int
    words: frozenset[int]


class Scanner:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = {t.name: t for t in templates}
        self.words = {t.name: words_of(t.text) for t in templates}
        self.must = {t.name: frozenset(words_of(" ".join(t.must))) for t in templates}
        self.telling: dict[str, dict[str, list[int]]] = {}
        for name, words in self.words.items():
            if not self.must[name] or not self.must[name] <= set(words):
                raise ValueError(f"template {name} lacks words that must be there")
            places = self.telling[name] = {}
            for j, w in enumerate(words):
                if w not in COMMON:
                    places.setdefault(w, []).append(j)
        self.triggers = frozenset().union(*self.must.values())

    def match(self, name: str, words: list[str], at: list[int], a: int, b: int) -> Match | None:
        """The template's match in the window from a to b of words, which stand at these places of the text."""
        a, b = max(0, a), min(b, len(words))
        template = self.words[name]
        got = align(words[a:b], template)
        if len(got) < self.threshold * len(template) or not self.must[name] <= {template[j] for _, j in got}:
            return None
        first, last = at[a + got[0][0]], at[a + got[-1][0]]
        if last + 1 - first > len(template) + (len(template) if len(template) >= SHORT else len(template) // 4):
            return None
        return Match(name, self.templates[name].license, round(len(got) / len(template), 6), first, last + 1, frozenset(at[a + i] for i, _ in got))

    def windows(self, name: str, words: list[str]) -> Iterator[tuple[int, int]]:
        """Where the template could be covered: narrow windows from where its words stand in their places, then wide ones."""
        telling, n = self.telling[name], len(self.words[name])
        places = [i for i, w in enumerate(words) if w in telling]
        votes = Counter(p - j for p in places for j in telling[words[p]])
        least = max(1, sum(map(len, telling.values())) // 4)
        for s in sorted(s for s, c in votes.items() if c >= least):
            for more in (0, n // 5):
                yield s, s + n + more
        # Fewer telling words than this within twice the length can't be a match.
        need = max(1, int(self.threshold * n) - sum(w in COMMON for w in self.words[name]))
        dense = {k for i, p in enumerate(places) if i + need <= len(places) and places[i + need - 1] - p < 2 * n for k in range(p // n - 2, p // n + 1)}
        for k in sorted(dense):
            yield k * n, (k + 3) * n

    def matches(self, name: str, words: list[str]) -> list[Match]:
        """All matches of one template that share no words: the best are taken out of the text, and the rest is aligned again."""
        out: list[Match] = []
        at = list(range(len(words)))
        while True:
            left = [words[i] for i in at]
            if not self.must[name] <= set(left):
                return out
            found = {m for a, b in self.windows(name, left) if (m := self.match(name, left, at, a, b))}
            taken: set[int] = set()
            for m in sorted(found, key=lambda m: (-m.coverage, m.end - m.first, m.first)):
                if taken.isdisjoint(m.words):
                    taken |= m.words
                    out.append(m)
            if not taken:
                return out
            at = [i for i in at if i not in taken]

    def scan(self, text: str | None) -> list[Match]:
        """The matches, best first, without those that share most of their words with a better one."""
        words = words_of(text)
        present = self.triggers.intersection(words)
        found = [m for name in self.templates if self.must[name] <= present for m in self.matches(name, words)]
        kept: list[Match] = []
        for m in sorted(found, key=lambda m: (-m.coverage, -len(self.words[m.template]), m.template, m.first)):
            if all(2 * len(m.words & k.words) <= len(m.words) for k in kept):
                kept.append(m)
        return kept


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, the best license with its coverage and place (null if none), and all matches."""
    Scanner(templates, threshold)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("license", "template", "coverage", "first_word", "end_word")
    kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, threshold)
        for b in batches:
            got = [[(m.license, m.template, m.coverage, m.first, m.end) for m in s.scan(t.as_py())] for t in b.column(1)]
            best = [g[0] if g else (None,) * 5 for g in got]
            cols = [pa.array([x[i] for x in best], kinds[i]) for i in (0, 2, 3, 4)]
            all_ = pa.array([[dict(zip(names, m, strict=True)) for m in g] for g in got], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, all_], names=["id", "license", "coverage", "first_word", "end_word", "matches"])

    read = with_small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    match = "struct<license:string,template:string,coverage:double,first_word:int,end_word:int>"
    out = read.mapInArrow(run, f"id {kind}, license string, coverage double, first_word int, end_word int, matches array<{match}>")
    return out.withColumnRenamed("id", id_col)
