"""Allocation, components and trackers against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framesift.operators import allocate as A
from framesift.operators import components as C
from framesift.operators import identity as P
from framesift.operators import signals as G


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(f"a{rnd.randrange(60)}", f"b{rnd.randrange(60)}") for _ in range(55)]
    edges += [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(70)]  # a long path
    edges += [("hub", f"leaf{i}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for node in list(parent):
        groups[find(node)].append(node)
    want = {n: min(g) for g in groups.values() for n in g}
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_generators_are_balanced(spark):
    names = [f"g{i}" for i in range(6)]
    clips = spark.createDataFrame([("t", i) for i in range(60)], "split string, clip long")
    for per_clip in (1, 2, 3):
        got = A.assign_generators(clips, "split", "clip", names, per_clip, "42").collect()
        assert len(got) == 60 * per_clip
        runs = Counter(r["generator"] for r in got)
        assert len(set(runs.values())) == 1
        by_clip = defaultdict(list)
        for r in got:
            by_clip[r["clip"]].append((r["generator"], r["cell"]))
        assert all(len({c for _, c in v}) == per_clip and len({g for g, _ in v}) == per_clip for v in by_clip.values())
        cells = Counter(r["cell"] for r in got)
        assert max(cells.values()) - min(cells.values()) <= 6


def test_pack_batches_matches_loop(spark):
    rnd = random.Random(2)
    data = [(s, s * 100 + i, rnd.uniform(0.2, 2.5), rnd.uniform(10, 200)) for s in range(12) for i in range(rnd.choice([1, 2, 9]))]
    df = spark.createDataFrame(data, "src long, vid long, h double, mb double").withColumn("rank", F.col("vid"))
    got = {r["vid"]: r["batch"] for r in A.pack_batches(df, "src", "vid", "rank", "h", "mb", 6.0, 700.0).collect()}
    want, batch, h, mb = {}, 0, 0.0, 0.0
    for s in range(12):
        part = [d for d in data if d[0] == s]
        th, tm = sum(d[2] for d in part), sum(d[3] for d in part)
        if batch == 0 or ((h + th > 6 or mb + tm > 700) and (h or mb)):
            batch, h, mb = batch + 1, 0.0, 0.0
        for d in part:
            if (th > 6 or tm > 700) and (h or mb) and (h + d[2] > 6 or mb + d[3] > 700):
                batch, h, mb = batch + 1, 0.0, 0.0
            want[d[1]] = batch
            h, mb = h + d[2], mb + d[3]
    assert got == want


def test_pack_batches_goes_on_in_the_open_batch(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 10.0), (2, 2, 3.0, 10.0), (3, 3, 3.0, 10.0)], "src long, vid long, h double, mb double").withColumn("rank", F.col("vid"))
    got = {r["vid"]: r["batch"] for r in A.pack_batches(df, "src", "vid", "rank", "h", "mb", 6.0, 700.0, open_batch=(4, 1.5, 20.0)).collect()}
    assert got == {1: 4, 2: 5, 3: 5}


def test_pack_batches_does_not_depend_on_size(spark):
    rows = spark.range(10_000).selectExpr("1L AS src", "id AS vid", "id AS rank", "0.4D AS h", "1.0D AS mb")
    got = A.pack_batches(rows, "src", "vid", "rank", "h", "mb", 2.1, 1e9).groupBy("batch").count().collect()
    assert len(got) == 2000 and all(r["count"] == 5 for r in got)


def test_ratio_splits_refuse(spark):
    few = spark.createDataFrame([("a", 1, None), ("b", 2, None)], "component string, n long, locked string")
    with pytest.raises(ValueError, match="Fewer groups"):
        A.assign_ratio_splits(few, "42")
    torn = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", None)], "component string, lock string")
    with pytest.raises(ValueError, match="two splits"):
        A.component_locks(torn, "component", "lock")


def test_ratio_splits_keep_locks_and_fill_all(spark):
    data = [(f"g{i}", n, "test" if i == 3 else None) for i, n in enumerate([30, 20, 10, 8, 5, 5, 4, 3, 2, 1])]
    df = spark.createDataFrame(data, "component string, n long, locked string")
    got = {r["component"]: r["split"] for r in A.assign_ratio_splits(df, "42").collect()}
    assert got["g3"] == "test" and set(got.values()) == {"train", "validation", "test"}
    share = Counter()
    for c, n, _ in data:
        share[got[c]] += n
    assert share["train"] > share["test"] > share["validation"]


def test_form_parts_balances_genders(spark):
    kinds = [(1, 1), (2, 0), (0, 2)]
    data = [(f"c{i:02d}", f"2024-01-{i + 1:02d}", *kinds[i % 3], i == 4) for i in range(15)]
    df = spark.createDataFrame(data, "component string, first string, m long, f long, blocked boolean")
    got = A.form_parts(df, 3).collect()
    assert {r["component"]: r["part"] for r in got if r["status"] == "blocked"} == {"c04": None} and len(got) == 15
    assert all((r["part"] is not None) == (r["status"] == "placed") for r in got)
    size = {d[0]: (d[2], d[3]) for d in data}
    parts = defaultdict(lambda: [0, 0])
    for r in got:
        if r["part"]:
            parts[r["part"]][0] += size[r["component"]][0]
            parts[r["part"]][1] += size[r["component"]][1]
    assert parts and all(v == [3, 3] for v in parts.values())


def test_gender_splits_hit_targets(spark):
    df = spark.createDataFrame([(f"s{i}", i % 2, 1 - i % 2, 10 + i % 5) for i in range(40)], "component string, m long, f long, clips long")
    got = {r["component"]: r["split"] for r in A.assign_gender_splits(df, {"train": (12, 12), "validation": (3, 3), "test": (5, 5)}, "1").collect()}
    men = Counter(got[f"s{i}"] for i in range(40) if i % 2)
    assert men == {"train": 12, "validation": 3, "test": 5}


def test_face_track_pieces_match_one_pass(spark):
    rnd = random.Random(4)
    data = []
    for t in range(300):
        n = 0 if rnd.random() < 0.35 else 1
        data.append(("v", t, n, rnd.random() < 0.9, rnd.uniform(0, 60), 0.0, 50.0, 50.0))
    df = spark.createDataFrame(data, "k string, t long, faces int, ok_geometry boolean, x double, y double, w double, h double")
    got = {r["t"]: r["valid"] for r in G.track_faces(df, ["k"], "t").collect()}
    last, missed, want = None, 0, {}
    for _, t, n, ok, x, y, w, h in data:
        good = n == 1 and ok
        if good and last is not None:
            good = ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 < 30
        want[t] = good
        if good:
            last, missed = (x, y), 0
        else:
            missed += 1
            last = None if missed > 2 else last
    assert got == want


def test_clusters_and_best_matches(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    base = np.eye(8)[:2]
    rows = [("in", i, (base[i % 2] + rnd.normal(0, 0.05, 8)).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "input string, id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in P.leader_clusters(df, "input", "id", "v", 0.5).collect()}
    assert Counter(got.values()) == {0: 5, 1: 4}
    known = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(30)], "key long, c array<double>")
    table = {r["key"]: np.array(r["c"]) for r in known.collect()}
    found = P.best_matches(df, "id", "v", known, "key", "c", 3).collect()
    for _, i, v in rows:
        want = sorted(table, key=lambda k: -float(table[k] @ np.array(v)))[:3]
        assert [r["key"] for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])] == want


def test_temporal_folds_take_arrays_and_keep_ties(spark):
    """No Pandas frame per clip; the last best span wins a tie, a clip without segments has one row, one without spans no hit."""
    from framesift.operators import metrics as M

    found = spark.createDataFrame([("a", 2.0, 0.0, 1.0), ("a", 1.0, 0.0, 1.0), ("a", 1.0, 5.0, 6.0), ("c", 1.0, 0.0, 1.0)], "clip string, score double, a double, b double")
    truth = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 1.0), ("b", 0.0, 1.0)], "clip string, a double, b double")
    out = M.match_segments(found, truth, "clip")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    hit = next(c for c in out.columns if c.startswith("hit_"))
    got = sorted(((r.clip, r.score, r.a, r.truths, r[hit]) for r in out.collect()), key=repr)
    assert got == [("a", 1.0, 0.0, 2, 1), ("a", 1.0, 5.0, 2, 0), ("a", 2.0, 0.0, 2, 1), ("b", None, None, 1, 0), ("c", 1.0, 0.0, 0, 0)]
