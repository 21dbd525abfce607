"""Donor counts and picks equal the plain pair loop, in one leaf and walked as a tree with heavy keys cut."""

import random

import pytest
from framesift.functions.hashing import stable_int
from framesift.operators.donors import dominance, donors, nearest_donor
from pyspark.sql import functions as F

KIND = "split string, speaker int, clip int, source string, a double, b double, d double"


def clips(n, rnd):
    rows = []
    for i in range(n):
        speaker = 0 if rnd.random() < 0.7 else rnd.randrange(1, 6)  # one speaker holds most clips
        a, d = rnd.randrange(0, 40) / 2, rnd.randrange(1, 24) / 4
        span = (a, a + d) if rnd.random() < 0.9 else rnd.choice([(None, None), (a, a)])
        rows.append(("x" if rnd.random() < 0.8 else "y", speaker, i, f"s{speaker}:{rnd.randrange(3)}", *span, None if rnd.random() < 0.04 else d))
    return rows


def apart(r, d):
    timed = all(x[4] is not None and x[4] < x[5] for x in (r, d))
    return r[3] != d[3] or not timed or d[5] <= r[4] or r[5] <= d[4]


def others(r, rows):
    return [d for d in rows if d[2] != r[2] and d[:2] == r[:2] and d[6] is not None and apart(r, d)] if r[6] is not None else []


@pytest.fixture(scope="module")
def table(spark):
    rows = clips(90, random.Random(3))
    return rows, spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.mark.parametrize("bits, hot", [(11, 1_000_000), (5, 40)])
def test_donors(spark, table, bits, hot):
    rows, df = table
    h = {r.clip: r.h for r in df.select("clip", stable_int(F.concat(F.lit("42:"), F.col("clip").cast("string"))).alias("h")).collect()}
    want = {}
    for r in rows:
        pool = sorted(d[2] for d in others(r, rows) if d[6] >= r[6] - 1.5 - 1e-6)
        want[r[2]] = (len(pool), pool[h[r[2]] % len(pool)] if pool else None)
    got = donors(df, ["split", "speaker"], "clip", "d", "source", "a", "b", 1.5, "42", bits, hot).collect()
    assert {r.clip: (r.pool, r.donor) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("bits, hot", [(11, None), (5, 40)])
def test_nearest_donor(spark, table, bits, hot):
    rows, df = table
    want = {}
    for r in rows:
        free = others(r, rows)
        up = min(((d[6], d[2]) for d in free if (d[6], d[2]) > (r[6], r[2])), default=None)
        down = max(((d[6], d[2]) for d in free if (d[6], d[2]) < (r[6], r[2])), default=None)
        if down and down[0] < r[6] - 0.5 - 1e-6:
            down = None
        if up and (not down or up[0] - r[6] <= r[6] - down[0]):
            want[r[2]] = (up[1], up[0] - r[6], False)
        elif down:
            want[r[2]] = (down[1], r[6] - down[0], False)
        else:
            want[r[2]] = (max(((d[6], d[2]) for d in free), default=(0, None))[1], None, True)
    got = nearest_donor(df, ["split", "speaker"], "clip", "d", "source", "a", "b", 0.5, bits, hot).collect()
    assert {r.clip: (r.donor, r.error, r.cut) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bits, hot", [(2, None), (3, 20)])
def test_dominance(spark, closed, bits, hot):
    rnd = random.Random(8)
    points = [(rnd.choice("aaab"), float(rnd.randrange(12)), float(rnd.randrange(12))) for _ in range(120)]
    asks = [(rnd.choice("aaab"), float(rnd.randrange(12)), float(rnd.randrange(12)), i) for i in range(80)]
    want = {i: sum(k == key and pu >= u and (pv <= v if closed else pv < v) for key, pu, pv in points) for k, u, v, i in asks}
    p, q = spark.createDataFrame(points, "k string, u double, v double"), spark.createDataFrame(asks, "k string, u double, v double, _ask long")
    assert {r._ask: r._count for r in dominance(p, q, ["k"], closed, bits, hot).collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert donors(none, ["split", "speaker"], "clip", "d", "source", "a", "b", 1.0, "1").collect() == []
    assert nearest_donor(none, ["split", "speaker"], "clip", "d", "source", "a", "b", 1.0).collect() == []


def test_small_leaves_together_are_like_one_by_one():
    import numpy as np
    import pyarrow as pa

    from framesift.operators import donors as D

    random, parts = np.random.default_rng(4), []
    for n in (1, 2, 7, 30, 3):
        for kind in (-1, D.BY_HASH, D.NEXT, D.BEFORE, D.LAST, D.GIVEN):
            a = random.integers(0, 20, n).astype(float)
            size = random.integers(1, 9, n).astype(float)
            parts.append(pa.table({"_kind": np.full(n, kind), "_p": np.arange(n), "_size": size, "_a": a, "_b": a + size - 2, "_x": size - 1, "_h": random.integers(0, 99, n),
                                   "_k": random.integers(-1, 4, n), "_id": np.arange(n) * 3, "_ask": np.arange(n) + 1000 * len(parts),
                                   "_source": pa.array([None if s == 2 else f"s{s}" for s in random.integers(0, 3, n)], pa.string())}))
    leaves = [pa.concat_tables(parts[i:i + 6]) for i in range(0, len(parts), 6)] + [parts[1]]  # the last one has no candidates
    starts = np.cumsum([0] + [t.num_rows for t in leaves[:-1]])
    want = pa.concat_tables([D._leaf(t) for t in leaves]).to_pylist()
    assert D._leaves(pa.concat_tables(leaves), starts).to_pylist() == want


def test_the_plan_finds_its_donors_once(spark, monkeypatch):
    from framesift.operators import donors as D
    from framesift.plans import load_all

    calls, real = spark.sparkContext.accumulator(0), D.in_buckets

    def counted(*args, together, **named):
        return real(*args, together=lambda *a: (calls.add(1), together(*a))[1], **named)

    monkeypatch.setattr(D, "in_buckets", counted)
    load_all()["d21_make_plan"].build(spark, "/root/testdata/sf0.001").count()
    assert 0 < calls.value <= int(spark.conf.get("spark.sql.shuffle.partitions"))
