import cProfile
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.llm import context_tree as tree


class Node:
    """A context tree of one binary decision, weighed by plain recursion."""

    def __init__(self):
        self.counts, self.children = [0, 0], {}

    def kt(self):
        a, b = self.counts
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log(self, depth):
        if depth == tree.DEPTH:
            return self.kt()
        return np.logaddexp(self.kt(), sum(c.log(depth + 1) for c in self.children.values())) + math.log(0.5)

    def chance(self, context, bit, depth=0):
        mine = (self.counts[bit] + 0.5) / (sum(self.counts) + 1)
        if depth == tree.DEPTH:
            return mine
        share = math.exp(self.kt() + math.log(0.5) - self.log(depth))
        child = self.children.get(context[-1 - depth])
        return share * mine + (1 - share) * (child.chance(context, bit, depth + 1) if child else 0.5)


def bits(byte):
    return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def brute(rows, held):
    trees = {}
    for key, text in rows:
        if key in held:
            continue
        raw = bytes(tree.DEPTH) + lower(text) + b"\0"
        for i in range(tree.DEPTH, len(raw)):
            for place, bit in bits(raw[i]):
                node = trees.setdefault(place, Node())
                node.counts[bit] += 1
                for d in range(tree.DEPTH):
                    node = node.children.setdefault(raw[i - 1 - d], Node())
                    node.counts[bit] += 1
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) + ["end"]
    count = Counter(w for k, t in rows if k not in held for w in words(t))
    total, distinct = sum(count.values()), len(count)
    out = []
    for key, text in rows:
        raw, score = bytes(tree.DEPTH) + lower(text) + b"\0", 0.0
        for i in range(tree.DEPTH, len(raw)):
            for place, bit in bits(raw[i]):
                score += math.log10(trees[place].chance(raw[i - tree.DEPTH:i], bit) if place in trees else 0.5)
        w = words(text)
        out.append((key, len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), score))
    return out


def test_against_plain_recursion(spark, docs_of):
    rows = [(1, "The cat sat on the mat. The cat ran."), (2, "the dog sat on the log"), (3, "THE cat\tand\nthe dog"), (4, None), (5, ""), (6, "a cat sat on a dög é"), (7, "zzz the"), (2, "the dog sat on the log")]
    held = {3, 7}
    got = sorted(tree.scored(docs_of(rows), F.col("doc_id").isin(*held)).collect(), key=repr)
    want = sorted(brute(rows, held), key=repr)
    for r, (key, n, known, total, base, score) in zip(sorted(got, key=lambda r: r.doc_id), sorted(want, key=lambda w: w[0])):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (key, n, known, total, key in held)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-9)


def test_blocks_make_no_difference(spark, docs_of, monkeypatch):
    rows = [(i, f"some text number {i % 7} " * (1 + i % 5)) for i in range(60)]
    run = lambda: sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in tree.scored(docs_of(rows), F.col("doc_id") % 5 == 1).collect())
    one = run()
    monkeypatch.setattr(tree, "BLOCK_BYTES", 200)
    assert run() == one


def test_chances_add_up():
    run = np.arange(256, dtype=np.uint64) | np.uint64(0x616263 << 8)
    levels = tree.near_levels(run[[97, 98, 98]], np.array([3, 1, 2]))
    context, place, bit = tree.decisions(run)
    chance = np.full(bit.shape, 0.5)
    for depth, level in zip(range(tree.DEPTH, tree.NEAR - 1, -1), levels):
        chance = level.predict(tree.node_at(context, place, depth), bit, chance)
    assert chance.prod(1).sum() == pytest.approx(1.0)


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.5, 100.0, 1e7])
    assert np.allclose(tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_held_out_texts_beat_the_word_counts(spark):
    out = tree.op9(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out.s > out.b


def test_nothing_to_learn_from(spark, docs_of):
    got = tree.scored(docs_of([(1, "ab"), (None, None)]), F.lit(True)).collect()
    assert {round(r.score, 6) for r in got} == {round(-24 * math.log10(2), 6), round(-8 * math.log10(2), 6)} and {r.train_tokens for r in got} == {0}
    assert tree.scored(docs_of([]), F.lit(False)).count() == 0


def test_the_sixth_byte_back_is_context():
    run, owner = tree.runs_of([b"1abcdex", b"2abcdex"])
    assert run[owner == 0][6] != run[owner == 1][6]


def test_runs_travel_packed(spark, docs_of, monkeypatch):
    """No table has a row per (block, run) or (block, word)."""
    docs = docs_of([(i, " ".join(f"w{(i * 37 + j) ** 2 % 9973}" for j in range(200))) for i in range(20)])
    sizes, write = {}, tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: (out := write(df, name), sizes.update({name: out.count()}))[0])
    assert tree.scored(docs, F.col("doc_id") % 5 == 1).count() == 20
    blocks = docs.rdd.getNumPartitions()
    assert all(n <= (blocks + 1) * int(spark.conf.get("spark.sql.shuffle.partitions")) for name, n in sizes.items() if name not in ("lm_nodes", "lm_level"))


def test_packed_numbers_and_words_come_back():
    x = np.array([0, 1, 255, 256, 1 << 55], np.int64)
    assert (tree.risen(tree.rising(x)) == x).all() and (tree.unsqueezed(tree.squeezed(x / 3), float) == x / 3).all()
    assert not len(tree.unsqueezed(tree.squeezed(x[:0]))) and tree.unlisted(tree.listed([])) == [] and tree.unlisted(tree.listed([b"a", tree.END])) == [b"a", tree.END]
    run = tree.runs_of(["abcabcd é".encode()])[0]
    assert (tree.turned(tree.turned(run)) == run).all()


def test_runs_are_ranked_by_one_plain_sort(monkeypatch):
    texts = [b"", b"the cat sat on the mat. " * 50, "sofør, schön\0 é".encode() * 9, b"", bytes(range(256)), b"\0" * 9, b"t"]
    for some in (texts, texts[:1], texts[1:2], texts[5:]):
        run, at = np.unique(tree.runs_of(some)[0], return_inverse=True)
        got, place = tree.ranked_runs(some)
        assert got.dtype == run.dtype and (got == run).all() and (place == at.ravel()).all()
    plain = tree.runs_of(texts[1:3])[0]
    monkeypatch.setattr(tree, "runs_of", None)  # usual texts never need the slower way
    assert (tree.ranked_runs(texts[1:3])[0] == np.unique(plain)).all()


def test_texts_of_too_many_letters_are_ranked_too():
    raw = np.random.default_rng(3).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    run, at = np.unique(tree.runs_of([raw, raw[:99]])[0], return_inverse=True)
    got, place = tree.ranked_runs([raw, raw[:99]])
    assert (got == run).all() and (place == at.ravel()).all()


def test_runs_are_counted_in_the_texts_to_learn_from():
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 256, 150_000).astype(np.uint8).tobytes()  # too many letters to number their threes
    for texts in ([b"", b"abc abc abc", b"abc", b""], [b""], [odd, b"abc", odd[:50]]):
        for train in (np.arange(len(texts)) % 2 == 1, np.zeros(len(texts), bool)):
            runs, owner = tree.runs_of(texts)
            run, at = np.unique(runs, return_inverse=True)
            got, n = tree.counted_runs(texts, train)
            assert (got == run).all() and (n == np.bincount(at.ravel(), weights=train[owner])).all()


def test_runs_are_dealt_in_one_order():
    run = np.unique(tree.runs_of([b"the cat sat on the mat, the dog sat on the log"])[0])
    for groups in (1, 5, 70_000):
        turn, order, group = tree.dealt_runs(run, groups)
        got = list(zip(group.tolist(), turn[order].tolist()))
        assert got == sorted(got) and sorted(order.tolist()) == list(range(len(run))) and max(group) < groups


def test_lists_of_runs_add_up():
    rng = np.random.default_rng(5)
    lists = [(np.unique(rng.integers(0, 99, 50).astype(np.uint64)),) for _ in range(4)]
    lists = [(r, rng.integers(0, 5, len(r))) for (r,) in lists]
    want = Counter()
    for r, n in lists:
        want.update({int(k): 0 for k in r})
        for k, c in zip(r, n):
            want[int(k)] += int(c)
    run, n = tree.merged(lists)
    assert dict(zip(run.tolist(), n.tolist())) == want and (np.diff(run.astype(np.int64)) > 0).all()


def test_words_are_cut_and_counted_as_by_split():
    texts = [b"", b" \t\n a\x0bb\x0cc\rd ", b"\x1c\x85 \xc2\xa0 e", b"   ", b"a a", b"", b"z"]
    words, sizes = tree.words_of(texts)
    assert words.to_pylist() == [w for t in texts for w in t.split()] and sizes.tolist() == [len(t.split()) for t in texts]
    distinct, uses, at = tree.counted(words, np.arange(len(words)))
    assert distinct.take(at).equals(words) and uses[distinct.to_pylist().index(b"a")] == sum(i for i, w in enumerate(words.to_pylist()) if w == b"a")
    order, group = tree.dealt_words(distinct, 3)
    mine = [distinct.to_pylist()[i] for i in order]
    assert sorted(zip(group.tolist(), mine)) == list(zip(group.tolist(), mine)) and sorted(mine) == sorted(distinct.to_pylist())
    assert not len(tree.words_of([b"", b" "])[0]) and tree.words_of([b"", b" "])[1].tolist() == [0, 0]


def test_a_block_takes_one_call_per_different_word():
    """Words are counted and dealt as arrays; only their group is found one by one."""
    words = [f"w{i}" for i in range(30_000)]
    docs = pa.record_batch({"key": [1, 2], "held_out": [False, True], "text": [" ".join(words), " ".join(words[::2])]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_batch(docs)
    batch = pa.record_batch({"block": [0], "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    profile = cProfile.Profile()
    rows = profile.runcall(lambda: list(tree.items([batch], 4)))[0].to_pylist()
    assert sorted(w for r in rows for w in tree.unlisted(r["words"])) == sorted([w.encode() for w in words] + [tree.END])
    assert sum(tree.unsqueezed(r["uses"]).sum() for r in rows) == 30_001
    assert sum(e.callcount for e in profile.getstats()) < 2 * len(words)
