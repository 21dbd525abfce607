"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.tables import read, small_batches

COVERED = 0.85  # share of a template's words that the alignment must match
SPREAD = 3  # matched words may lie in a stretch of at most so many times the template's words

# License notices as they are usually written into files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
 compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
 applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
 OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
 under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
 files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
 publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
 subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
 portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
 THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
 as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
 distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
 FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
 disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
 in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
 contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
 that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
 with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# ASCII letters in lower case; ASCII marks other than . - / become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c in b".-/" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, split at white space and marks, without dots, dashes and slashes around them."""
    return [w for w in (x.strip(b".-/") for x in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()) if w]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run of picks, by piles of smallest ends."""
    ends, at, back = [], [], []
    for i, v in enumerate(values):
        p = bisect_left(ends, v)
        back.append(at[p - 1] if p else -1)
        if p == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template), both increasing.

    Equal ends are matched outright; words unique to both sides anchor a longest increasing
    subsequence, and each gap between anchors is aligned in the same way. The work list keeps its own
    stack, so depth is no limit.
    """
    pairs, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        here = Counter(w for w in text[a:b] if w in wanted)
        place = {template[i]: i for i in range(c, d)}
        anchors = [(i, place[text[i]]) for i in range(a, b) if here.get(text[i]) == 1 and wanted[text[i]] == 1]
        if not anchors:
            continue
        anchors = [anchors[i] for i in longest_increasing([t for _, t in anchors])]
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def stretches(words: list[bytes], template: list[bytes], covered: float) -> list[tuple[int, int]]:
    """Parts of a text where a template may stand: enough of its different words lie together."""
    wanted = set(template)
    hits = [i for i, w in enumerate(words) if w in wanted]
    size, need = SPREAD * len(template), covered * len(wanted)
    out, lo, inside = [], 0, Counter()
    for i in hits:
        inside[words[i]] += 1
        while i - hits[lo] >= size:
            inside[words[hits[lo]]] -= 1
            inside += Counter()
            lo += 1
        if len(inside) >= need:
            a, b = hits[lo], i + 1
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def windows(words: list[bytes], template: list[bytes], a: int, b: int) -> list[tuple[int, int]]:
    """The stretch, and its parts around each place of a word that stands once in the template, from the
    word's place before to its place after: there the word is unique, however many copies stand together."""
    once = {w for w, n in Counter(template).items() if n == 1}
    size, places = SPREAD * len(template), defaultdict(list)
    for i in range(a, b):
        if words[i] in once:
            places[words[i]].append(i)
    out = {(a, b)}
    for at in places.values():
        for before, i, after in zip([a - 1, *at], at, [*at[1:], b]):
            out.add((max(before + 1, i - size + 1), min(after, i + size)))
    return sorted(out)


def best_cover(words: list[bytes], template: list[bytes], covered: float = COVERED) -> tuple[float, int, int]:
    """(coverage, first word, end word) of the best alignment in a whole text; (0, 0, 0) without one."""
    best = (0.0, 0, 0)
    for a, b in sorted({w for s in stretches(words, template, covered) for w in windows(words, template, *s)}):
        if best[0] == 1 and best[1] <= a:
            break  # no later window holds a better or an earlier one
        pairs = aligned(words[a:b], template)
        if pairs:
            got = (len(pairs) / len(template), a + pairs[0][0], a + pairs[-1][0] + 1)
            best = max(best, got, key=lambda x: (x[0], -x[1]))
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", covered: float = COVERED) -> DataFrame:
    """One row per document: key, licence (the template covered best, null if none reaches `covered`),
    coverage, first_word and end_word of its alignment, and `found`, all covered templates in order of name.

    Ties go to the longer template, then to the smaller name. Null and empty texts have no license;
    repeated rows are alike. Whole texts are scanned.
    """
    small_batches(docs.sparkSession)
    table = {n: words_of(t) for n, t in sorted((templates or TEMPLATES).items())}
    kind = docs.schema[key].dataType.simpleString()

    def look(batches):
        for b in batches:
            rows = []
            for t in b["_text"].to_pylist():
                words = words_of(t)
                there = set(words)
                got = []
                for name, template in table.items():
                    if template and len(there.intersection(template)) >= covered * len(set(template)):
                        cover, first, end = best_cover(words, template, covered)
                        if cover >= covered:
                            got.append((cover, len(template), name, first, end))
                top = min(got, key=lambda g: (-g[0], -g[1], g[2]), default=(None, 0, None, None, None))
                rows.append((top[2], top[0], top[3], top[4], ",".join(g[2] for g in got)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b["_key"], *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()))]],
                                             ["_key", "licence", "coverage", "first_word", "end_word", "found"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(look, f"_key {kind}, licence string, coverage double, first_word long, end_word long, found string").withColumnRenamed("_key", key)


def op5(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
