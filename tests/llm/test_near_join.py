import random
import re

import numpy as np
import pytest

from framesift.llm import near_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """class and links of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(linked):
            low = min([label[i], *(label[j] for j in others)])
            if low < label[i]:
                label[i], changed = low, True
    groups = {}
    for i, lab in enumerate(label):
        groups.setdefault(lab, []).append(rows[i][0])
    return sorted((rows[i][0], min(groups[label[i]]), len(linked[i])) for i in range(len(rows)))


def corpus(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    passage = r.choices(vocabulary, k=40)
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            words = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.randint(1, 90)) + (passage if kind < 0.7 else [])))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, docs_of, seed):
    rows = corpus(seed) + [(900, ""), (901, None), (902, "  "), (903, "two words"), (904, "two  words"), (905, "a b c d"), (906, "x " * 3000)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.joined(docs_of(rows)).collect())
    assert got == brute(rows)


def test_splitting_and_tiles_lose_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_join, "BUCKET", 16)
    monkeypatch.setattr(near_join, "TILE", 8)
    rows = corpus(3, 160)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.joined(docs_of(rows)).collect())
    assert got == brute(rows)


def test_overlaps_and_roots():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = near_join.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))
    links = np.zeros((6, 6), bool)
    for a, b in ((5, 1), (1, 3), (2, 4)):
        links[a, b] = links[b, a] = True
    assert near_join.roots(links).tolist() == [0, 1, 2, 1, 2, 1]


def test_deduplicated_with_repeated_and_null_keys(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (2, long + " x"), (3, "other words stand here alone"), (3, "other words stand here alone"), (4, ""), (5, None), (7, "same key one two three"), (7, "same key four five six")]
    out = near_join.deduplicated(docs_of(rows).selectExpr("*", "'k' AS key", "1 AS node"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "node"]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted([(1, long), (3, rows[2][1]), (4, ""), (5, ""), (7, rows[6][1]), (7, rows[7][1])])
    assert near_join.deduplicated(docs_of([])).count() == 0
    nulls = near_join.joined(docs_of([(None, long), (8, long)])).collect()
    assert {r.n_links for r in nulls} == {1}


def leaf_rows(monkeypatch):
    """Tables a join writes, by name."""
    seen, plain = {}, near_join.written
    monkeypatch.setattr(near_join, "written", lambda df, name: seen.setdefault(name, plain(df, name)))
    return seen


def test_a_common_line_does_not_multiply_rows(spark, docs_of, monkeypatch):
    """Texts that share a line and little else meet in one bucket that draws do not split; no rows for each two parts of it."""
    monkeypatch.setattr(near_join, "BUCKET", 16)
    monkeypatch.setattr(near_join, "COMMON", 8)
    r = random.Random(5)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [line + " " + " ".join(r.choices([f"v{i}" for i in range(500)], k=20)) for _ in range(300)]
    rows = list(enumerate(texts + [t + " more" for t in texts[:40]]))
    seen = leaf_rows(monkeypatch)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_join.joined(docs_of(rows)).collect())
    assert got == brute(rows)
    assert seen["join_leaves"].count() < 20 * len(rows)
    assert seen["join_edges"].count() < len(rows)  # texts that share a line only are no group


def test_similar_sets_share_enough_of_their_sketches():
    r = np.random.default_rng(1)
    for n in (1, 3, 5, 20, 60, 64, 65, 80, 130, 400, 3000):
        for m in {n, -(-4 * n // 5), n * 5 // 4}:
            both = -(-4 * (n + m) // 9)
            if both > min(n, m):
                continue
            for _ in range(20):
                x = r.integers(0, 2**63, n + m - both).astype(np.uint64)
                sketches = [np.unique(near_join.sketch_of(s)) for s in (x[:n], x[n - both:])]
                lost = np.array([min(k, near_join.SKETCH) - len(s) for k, s in zip((n, m), sketches)])
                assert near_join.alike(near_join.overlaps(sketches), np.array([n, m]), lost)[0, 1], (n, m)
    far = [near_join.sketch_of(s) for s in (x[:50], x[25:75], x[:120])]
    assert not near_join.alike(near_join.overlaps(far), np.array([50, 50, 120]), np.zeros(3, int))[np.triu_indices(3, 1)].any()
