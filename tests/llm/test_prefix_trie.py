import hashlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from framesift.llm import prefix_trie as m

KIND = "conv_id long, turn int, role string, text string"


def plain(convs):
    """convs: id → list of (role, text). Walks every prefix of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        out, open_ = [], [node]
        while open_:
            top = open_.pop()
            out.append(top)
            open_ += children[top]
        return out

    rows = []
    for node, who in members.items():
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), sum(not children[u] for u in under),
                     sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in under if u), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, convs):
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    return spark.createDataFrame(rows[::-1], KIND).repartition(4)


SAMPLE = {i: [("user", "hi"), ("assistant", f"é{i % 3}"), ("user", "x" * (i % 4))][:1 + i % 3] for i in range(40)} | {
    50: [("user", "hi")] * 30, 51: [("user", "hi")] * 17 + [("bot", "hi")] * 9, 52: [("user", "hi")] * 30, 60: [("", "")], 61: [("", ""), ("", "")], 70: [("userh", "i")]}


@pytest.mark.parametrize("options", [{}, {"block": 4, "chunk": 2, "shard_rows": 20}, {"block": 7, "hot_rows": 5, "chunk": 3}])
def test_nodes_equal_the_plain_walk(spark, options):
    """Whole, and with long conversations cut into blocks, hot ones into ranges, and ids into short texts."""
    turns = m.turns_of(table(spark, SAMPLE), hot_rows=options.get("hot_rows"))
    assert got(m.trie(m.with_roots(turns), **options)) == plain(SAMPLE)


def test_rebuild(spark):
    convs = {c: [("user", f"q{(c // 5) % 4} {i if c % 3 else 0}") for i in range(1 + c % 10)] for c in [*range(0, 60), *range(71, 75), 1001]}
    want = {}
    for c, turns in convs.items():
        h = crc32(b"%d" % c) % 9
        want[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in want.values())  # a turnless one ends at the root
    assert got(m.trie(m.rebuilt(m.turns_of(table(spark, convs))))) == plain(want)


def test_nulls_ties_empty_and_clashing_names(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 0, "user", "lost"), (2, None, "user", "first")]
    turns = spark.createDataFrame(rows, KIND)
    for name in ("c", "pos", "mark", "depth", "a", "_part"):
        turns = turns.withColumn(name, turns.turn)
    made = m.trie(m.with_roots(m.turns_of(turns)))
    found = {(r.conv_id, r.depth): r for r in made.collect()}
    assert found[(1, 0)].n_convs == 2 and found[(1, 1)].n_convs == 2 and found[(1, 1)].saved_tokens == 5 and len(found) == 5
    assert found[(1, 4)].n_leaves == 1 and found[(1, 1)].ends_sha256 == hashlib.sha256(b"2").hexdigest()
    assert m.trie(m.rebuilt(m.turns_of(turns.limit(0)))).collect() == []
    long_ = spark.createDataFrame([(7, 0, "user", "w " * 500_000), (8, 0, "user", "w " * 500_000)], KIND)
    assert sorted((r.depth, r.saved_tokens) for r in m.trie(m.with_roots(m.turns_of(long_))).collect()) == [(0, 1_000_000), (1, 1_000_000)]


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        table_ = m.SlotTable(a, b)
        assert sorted(table_.find(a, b)) == list(range(n))  # minimal and perfect
        assert (table_.find(a, b ^ np.uint64(1)) == -1).all()  # verified
        assert len(m.distinct(np.tile(a, 3), np.tile(b, 3))) == n


def test_two_prefixes_under_one_digest_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, 7, 7, 0, 0, b"x", 1, True), (2, 1, 7, 7, 0, 0, b"y", 1, True)],
                                 "c long, depth long, a long, b long, pa long, pb long, mark binary, bytes long, last boolean")
    with pytest.raises(Exception, match="share a digest"):
        m.nodes_of(rows).collect()
