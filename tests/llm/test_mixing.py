from collections import Counter

import pytest
from pyspark.sql import functions as F

from framesift.llm import mixing


def water_fill(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), [s for s in names if sizes[s]]
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - limit * sizes[s]) for s in names)
        target = {s: min(t, limit * sizes[s]) for s, t in target.items()}
        free = [s for s in free if target[s] < limit * sizes[s]]
    return target


def test_targets_against_resharing(spark, docs_of):
    rows = [(i, "w " * (1 + i % 7), None if i % 11 == 0 else f"s{i % 9}") for i in range(300)] + [(900, "", "blank"), (901, None, "blank")]
    docs = mixing.sized(docs_of(rows))
    got = {r.source: (r.source_size, r.target) for r in mixing.source_rates(docs).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = water_fill(sizes)
    assert {s: g[0] for s, g in got.items()} == dict(sizes)
    for s, t in want.items():
        assert got[s][1] == pytest.approx(t)
    assert got["blank"][1] == 0


def test_copies_follow_rates_and_repeat(spark, docs_of):
    rows = [(i, "one two three", f"s{i % 4}") for i in range(4000)]
    docs = mixing.sized(docs_of(rows))
    rates = mixing.source_rates(docs)
    once, again = (sorted(mixing.copies(docs, rates).select("doc_id", "copies").collect()) for _ in range(2))
    assert once == again and max(c for _, c in once) <= 2
    taken = mixing.copies(docs, rates).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.max("target").alias("g")).collect()
    for r in taken:
        assert r.t == pytest.approx(r.g, rel=0.08)


def test_mix_keeps_columns_and_odd_rows(spark, docs_of):
    odd = docs_of([(1, None), (2, ""), (None, "a b"), (3, "x " * 5), (3, "x " * 5)]).withColumn("size", F.lit(7)).withColumn("copies", F.lit("c"))
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert mixing.mix(docs_of([])).count() == 0
    assert {r["copies"] for r in out.collect()} <= {"c"}
