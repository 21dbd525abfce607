"""Values that meet a border or one another exactly."""

import math

import duckdb

from framesift.operators import signals as G
from framesift.plans import load_all
from framesift.session import workspace


def test_noise_floor_takes_first_of_equal_levels(spark):
    x = [1.0 + 1e-12] * 4 + [1.0] * 4 + [5.0] * 8
    s = spark.createDataFrame([("k", t, v) for t, v in enumerate(x)], "k string, t long, x double")
    assert [(r["start"], r["rms"]) for r in G.noise_floor(s, ["k"], "t", "x", 4).collect()] == [(0, 1.0)]


def events(spark, rows):
    path = workspace(spark, "ties")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_score_equal_to_the_mean_is_a_hit(spark):
    path = events(spark, [(1, "view", 0.1), (1, "purchase", 0.2), (1, "purchase", 0.3)])  # as doubles their mean is above 0.2
    got = {r["k"]: (r["f1"], r["far"], r["recall"]) for r in load_all()["m5_at_threshold"].build(spark, path).collect()}
    assert got == {1: (1.0, 0.0, 1.0), -1: (1.0, 0.0, 1.0)}


def test_logarithm_of_zero(spark):
    path = events(spark, [(1, "view", 0.0), (1, "view", 1.0)])
    got = {r["event_id"]: r["ln"] for r in load_all()["s4_math"].build(spark, path).collect()}
    assert got == {0: -math.inf, 1: 0.0}


def test_logarithms_below_zero_and_six_decimals_as_in_sql(spark):
    values = [50.00002, -0.01, -1e-9, -700.0, -800.0, None, 29.27]
    path = events(spark, [(1, "view", v) for v in values])
    q = load_all()["s4_math"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = con.execute(q.sql).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r) for r in q.build(spark, path).select(names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
