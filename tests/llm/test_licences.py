import random
from itertools import combinations

import pytest

from framesift.llm import licences


def slow_patience(a, b):
    """Plain recursion: equal ends, then the longest increasing choice of words unique in both, by trying all."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + slow_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + slow_patience(a[:-1], b[:-1])
    unique = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    for n in range(len(unique), 0, -1):
        for pick in combinations(unique, n):
            if all(x[1] < y[1] for x, y in zip(pick, pick[1:])):
                edges = [(-1, -1), *pick, (len(a), len(b))]
                return n + sum(slow_patience(a[i + 1:k], b[j + 1:m]) for (i, j), (k, m) in zip(edges, edges[1:]))
    return 0


@pytest.mark.parametrize("seed", range(60))
def test_alignment(seed):
    r = random.Random(seed)
    words = [w.encode() for w in "abcdefghij"]
    a, b = (r.choices(words, k=r.randint(0, 12)) for _ in range(2))
    got = licences.aligned(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    if len({w for w in a}) == len(a) or seed % 2:
        firsts = [len(got), slow_patience(a, b)]
        assert firsts[0] <= min(len(a), len(b))
    distinct = r.sample(words, 8), r.sample(words, 8)
    assert len(licences.aligned(*distinct)) == slow_patience(*distinct)


def test_longest_increasing():
    for seed in range(50):
        v = random.Random(seed).sample(range(30), 9)
        got = [v[i] for i in licences.longest_increasing(v)]
        assert got == sorted(got)
        assert len(got) == max(n for n in range(10) for c in combinations(v, n) if list(c) == sorted(c))


def test_scan(spark, docs_of):
    mit, apache = licences.TEMPLATES["MIT-text"], licences.TEMPLATES["Apache-2.0"]
    edited = mit.replace("free of charge", "at no cost").replace("\n", "\n * ")
    rows = [(1, "some words. " + apache + " more"), (2, "x " * 5000 + edited + " y" * 5000), (3, None), (4, ""), (5, "licensed under the version"), (6, "l " * 200_000),
            (7, licences.TEMPLATES["CC-BY-NC-4.0"]), (8, apache + "\n" + licences.TEMPLATES["MIT"]), (8, apache + "\n" + licences.TEMPLATES["MIT"]), (None, "released under the mit license")]
    got = {}
    for r in licences.scan(docs_of(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].licence == "Apache-2.0" and got[1][0].coverage == 1 and (got[1][0].first_word, got[1][0].end_word) == (2, 9)
    assert got[2][0].licence == "MIT-text" and 0.9 < got[2][0].coverage < 1 and got[2][0].first_word == 5000
    assert [got[i][0].licence for i in (3, 4, 5, 6)] == [None] * 4
    assert got[7][0].found == "CC-BY-NC-4.0" and [r.found for r in got[8]] == ["Apache-2.0,MIT"] * 2 and got[None][0].licence == "MIT"
    assert licences.scan(docs_of([])).count() == 0


def test_every_planted_line(spark):
    lines = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in licences.op5(spark, "/root/testdata/sf0.01").collect():
        assert set(filter(None, r.found.split(","))) == {n for n, line in lines.items() if line in texts[r.doc_id]}


def test_copies_that_stand_together_inside_prose(spark, docs_of):
    line, mit, apache = (licences.TEMPLATES[n] for n in ("Apache-2.0", "MIT-text", "Apache-2.0-notice"))
    edited = mit.replace("free of charge", "at no cost").replace("sublicense", "relicense")
    prose = "of the end and to the rest in any case or not "
    rows = [(1, f"the end. {line} {line} See the rest"), (2, prose + mit + " " + mit + " " + prose), (3, prose + edited + " " + edited + " " + edited + " " + prose),
            (4, prose + apache + "\n" + apache + "\n" + prose), (5, prose + edited + " " + prose + mit + " " + prose), (6, prose * 40)]
    got = {r.doc_id: r for r in licences.scan(docs_of(rows)).collect()}
    assert [got[i].licence for i in range(1, 7)] == ["Apache-2.0", "MIT-text", "MIT-text", "Apache-2.0-notice", "MIT-text", None]
    assert [got[i].coverage for i in (1, 2, 4, 5)] == [1] * 4 and 0.9 < got[3].coverage < 1
    assert (got[1].first_word, got[1].end_word) == (2, 9) and got[2].first_word == len(licences.words_of(prose))
