"""The split path must give the same rows as a plain window. One key holds most rows here."""

import random

import pytest
from pyspark.sql import functions as F

from framesift.operators import metrics as M
from framesift.operators.intervals import fill_gaps, resample
from framesift.operators.joins import as_of, lag_sums, spread_join
from framesift.operators.ordered import HOT_ROWS, halo, light, merge_spans, ordered, positions, previous, running, runs
from framesift.operators.signals import exact_quantiles, pool, proposals

HOT = 25  # forces the key "big" onto the range path


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(5)
    data = []
    for key, n in (("big", 400), ("b", 12), ("c", 1)):
        at = 0
        for i in range(n):
            at += rnd.choice([0, 1, 1, 3])
            data.append((key, at, i, None if rnd.random() < 0.3 else round(rnd.uniform(0, 9), 2), rnd.random() < 0.7))
    return spark.createDataFrame(data, "k string, at long, id long, v double, ok boolean").cache()


def same(a, b, rows):
    assert rows(a) == rows(b)


def test_light_sees_the_heavy_key(series):
    assert light(series, ["k"], HOT_ROWS)
    assert not light(series, ["k"], HOT)


@pytest.mark.parametrize("order", [["at", "id"], ["-at", "id"], ["-id"]])
def test_positions(series, rows, order):
    same(positions(series, ["k"], order, hot_rows=HOT), positions(series, ["k"], order), rows)


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_folds(series, rows, exclusive):
    specs = {"s": ("sum", F.round(F.col("v") * 100).cast("long")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    a = running(series, ["k"], ["at", "id"], specs, exclusive, hot_rows=HOT)
    same(a, running(series, ["k"], ["at", "id"], specs, exclusive), rows)


def test_previous(series, rows):
    same(previous(series, ["k"], ["at", "id"], {"p": "v", "pid": "id"}, HOT), previous(series, ["k"], ["at", "id"], {"p": "v", "pid": "id"}), rows)


def test_merge_spans(series, rows):
    spans = series.select("k", F.col("at").cast("double").alias("a"), (F.col("at") + F.coalesce("v", F.lit(0.5)) / 4).alias("b"))
    same(merge_spans(spans, ["k"], "a", "b", 0.5, HOT), merge_spans(spans, ["k"], "a", "b", 0.5), rows)


def test_runs_across_blocks(series, rows):
    same(runs(series, ["k"], "id", F.col("ok"), {"n": "at"}, block=7), runs(series, ["k"], "id", F.col("ok"), {"n": "at"}), rows)
    always = runs(series, ["k"], "id", F.lit(True), block=5)
    assert rows(always, "k", "start", "stop") == [("b", 0, 12), ("big", 0, 400), ("c", 0, 1)]


def test_halo_across_blocks(series, rows):
    def look(w):
        return {"p": F.lag("at", 3).over(w), "n": F.lead("at", 2).over(w), "m": F.sum("at").over(w.rowsBetween(-3, 3))}

    same(halo(series, ["k"], "id", 3, look, block=8), halo(series, ["k"], "id", 3, look), rows)


def test_lag_sums_across_blocks(series, rows):
    s = series.withColumn("x", F.coalesce("v", F.lit(1.0)))
    terms = {"xy": lambda a, b: F.round(a["x"] * b["x"] * 1e4).cast("long")}
    a = lag_sums(s, ["k"], "id", terms, "ok", ["x"], 4, block=9)
    same(a, lag_sums(s, ["k"], "id", terms, "ok", ["x"], 4), rows)


def test_quantiles_match_numpy(series):
    import numpy as np

    got = {r["k"]: r for r in exact_quantiles(series, ["k"], "v", {"q1": 0.01, "q5": 0.5, "q9": 0.95}, HOT).collect()}
    for key, row in got.items():
        values = [r["v"] for r in series.where((F.col("k") == key) & F.col("v").isNotNull()).collect()]
        assert row["n"] == len(values)
        assert np.allclose([row["q1"], row["q5"], row["q9"]], np.quantile(values, [0.01, 0.5, 0.95]))


def test_auc_matches_pairs(series):
    scored = series.withColumn("y", F.col("ok").cast("int")).withColumn("v", F.round("v"))
    for hot in (HOT, HOT_ROWS):
        got = {r["k"]: r["auc"] for r in M.auc(scored, ["k"], "v", "y", hot_rows=hot).collect()}
        for key in ("big", "b", "c"):
            data = [(r["v"], r["y"]) for r in scored.where((F.col("k") == key) & F.col("v").isNotNull()).collect()]
            pos, neg = [v for v, y in data if y], [v for v, y in data if not y]
            wins = [(p > q) + 0.5 * (p == q) for p in pos for q in neg]
            assert got.get(key) == (pytest.approx(sum(wins) / len(wins)) if wins else None)


def test_other_ordered_operators(series, rows):
    s = series.withColumn("t", F.col("id"))
    same(fill_gaps(s, ["k"], "t", "v", "f", HOT), fill_gaps(s, ["k"], "t", "v", "f"), rows)
    timed = series.withColumn("since", F.col("at").cast("double"))
    same(resample(timed, ["k"], ["at", "id"], "since", 4.0, HOT), resample(timed, ["k"], ["at", "id"], "since", 4.0), rows)
    grid = series.select("k", (F.col("at") + 1).alias("at")).distinct()
    once = series.groupBy("k", "at").agg(F.max("id").alias("id"))
    same(as_of(grid, once, ["k"], "at", ["id"], HOT), as_of(grid, once, ["k"], "at", ["id"]), rows)
    scored = series.where("v IS NOT NULL")
    keep = ["k", "top_share", "top_k", "max"]
    a, b = (pool(scored, ["k"], "v", "id", F.col("ok"), hot_rows=h).select("k", *[F.round(c, 9).alias(c) for c in keep[1:]]) for h in (HOT, HOT_ROWS))
    same(a, b, rows)


def test_metrics_on_heavy_keys(series, rows):
    scored = series.where("v IS NOT NULL").withColumn("y", F.col("ok").cast("int")).where("k <> 'c'")
    for f in (M.eer, M.best_threshold, M.average_precision):
        a, b = f(scored, ["k"], "v", "y", HOT), f(scored, ["k"], "v", "y")
        names = [c for c in a.columns if c != "k"]
        same(a.select("k", *[F.round(c, 9) for c in names]), b.select("k", *[F.round(c, 9) for c in names]), rows)


def test_proposals_in_rounds_match_one_task(series, rows):
    s = series.withColumn("v", F.coalesce("v", F.lit(0.0)) + F.col("id") / 1000)
    a, b = (proposals(s, ["k"], "id", "v", hot_rows=h).select("k", "a", "b", F.round("score", 9).alias("s")) for h in (HOT, HOT_ROWS))
    same(a, b, rows)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_is_a_join(spark, series, rows, how):
    some = series.withColumn("k", F.when(F.col("id") % 7 != 0, F.col("k")))  # a seventh has no key
    totals = series.where("k <> 'c'").groupBy("k").agg(F.sum("v").cast("decimal(12,2)").alias("sum"))
    same(spread_join(some, totals, ["k"], how, ["id"], HOT), spread_join(some, totals, ["k"], how, hot_rows=None), rows)
    same(spread_join(some, totals, ["k"], how, None, HOT), spread_join(some, totals, ["k"], how), rows)
    assert spread_join(some.limit(0), totals, ["k"], how, hot_rows=HOT).count() == 0


def test_spread_join_deals_a_hot_key(spark):
    """Half of the rows in one key: no task of the join reads more than three medians."""
    table = spark.range(60_000, numPartitions=8).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    totals = table.groupBy("k").agg(F.count("*").alias("n"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(c, v)
        joined = spread_join(table, totals, ["k"], hot_rows=400)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 60_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("order", [["id"], ["-id"], ["score", "id"], ["-score", "id"], ["score", "-n"], ["-score", "n"]])
def test_heavy_keys_are_cut_on_the_whole_tuple(spark, rows, order):
    """Long common beginnings of ids and two distinct scores still give many ranges, in the right order."""
    n = F.when(F.col("i") % 50 != 0, F.col("i"))
    df = spark.range(2000).select(F.col("id").alias("i")).select(
        F.lit("k").alias("k"), F.format_string("sample_%08d", "i").alias("id"), (F.col("i") % 2 / 2).alias("score"), n.alias("n"), "i")
    cut = ordered(df, ["k"], order, 100)
    ranges = cut.df.groupBy("_range").count().collect()
    wanted = 2 if order == ["-score", "id"] else 8  # a text cannot be turned round, so its ties stay together
    assert len(ranges) >= wanted and (wanted == 2 or max(r["count"] for r in ranges) <= 800)
    if order[-1].lstrip("-") == "id":
        same(positions(df, ["k"], order, hot_rows=100), positions(df, ["k"], order), rows)
    else:
        same(positions(df, ["k"], [*order, "i"], hot_rows=100), positions(df, ["k"], [*order, "i"]), rows)
