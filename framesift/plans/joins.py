"""Joins (J1–J12; J11 sits with the identity queries)."""

from pyspark.sql import functions as F

from framesift.functions.rules import noticeable, sync_correction
from framesift.operators import joins
from framesift.operators.donors import donors
from framesift.plans.fixtures import CLIPS, CROSSING, MEASURED, SERIES, clips, crossing_clips, hash_sql, measured, series
from framesift.plans.registry import query
from framesift.session import table

LIT = F.lit


@query("j1_inner_join", "J1", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def j1(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select("o_orderkey", "c_name", "n_name"))


@query("j2_left_join", "J2", """
SELECT c_custkey, o_orderkey, n_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000
LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1""")
def j2(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    n = table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    return (c.join(o, c.c_custkey == o.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
            .select("c_custkey", "o_orderkey", "n_name"))


@query("j3_semi_join", "J3", """
SELECT min(o_orderkey) AS first_order, count(*) AS n FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j3(spark, sf):
    local = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.join(local, o.o_custkey == local.c_custkey, "left_semi").agg(
        F.min("o_orderkey").alias("first_order"), F.count(LIT(1)).alias("n"))


@query("j4_unfinished_jobs", "J4", """
SELECT o_orderkey AS clip_id, arm FROM orders, (VALUES ('A'), ('N'), ('R')) v(arm)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = arm)""")
def j4(spark, sf):
    arms = F.explode(F.array(*[LIT(a) for a in "ANR"])).alias("arm")
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), arms)
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip_id"),
                                               F.col("l_returnflag").alias("arm"))
    return jobs.join(done, ["clip_id", "arm"], "left_anti")


@query("j5_donor_pool", "J5", f"""WITH {CROSSING},
p AS (SELECT clip_id, list(other ORDER BY other) AS pool FROM apart WHERE size >= duration_s - 5.0 - 1e-6 GROUP BY 1)
SELECT clip_id, coalesce(len(pool), 0)::BIGINT AS pool, pool[1 + {hash_sql("'42:' || clip_id::VARCHAR")} % len(pool)] AS donor FROM crossing LEFT JOIN p USING (clip_id)""")
def j5(spark, sf):
    c = crossing_clips(spark, sf)
    return donors(c, ["split", "speaker_id"], "clip_id", "duration_s", "source_id", "start_s", "end_s", 5.0, "42").select("clip_id", "pool", "donor")


@query("j6_full_sibling", "J6", """
WITH s AS (SELECT 'c' || o_orderkey::VARCHAR || '_' || kind AS sample_id, kind, o_orderkey FROM orders, (VALUES ('partial'), ('full')) v(kind)
  WHERE NOT (kind = 'full' AND o_orderkey % 9 = 0))
SELECT sample_id, CASE WHEN kind = 'full' THEN sample_id WHEN o_orderkey % 9 = 0 THEN NULL
  ELSE replace(sample_id, '_partial', '_full') END AS measured_on FROM s""")
def j6(spark, sf):
    kinds = F.explode(F.array(LIT("partial"), LIT("full"))).alias("kind")
    s = table(spark, sf, "orders").select("o_orderkey", kinds).where(
        ~((F.col("kind") == "full") & (F.col("o_orderkey") % 9 == 0)))
    s = s.select(F.concat(LIT("c"), "o_orderkey", LIT("_"), "kind").alias("sample_id"))
    sibling = F.regexp_replace("sample_id", "_partial$", "_full")
    ids = s.select(F.col("sample_id").alias("measured_on"))
    return s.withColumn("measured_on", sibling).join(ids, "measured_on", "left_semi").unionByName(
        s.withColumn("measured_on", sibling).join(ids, "measured_on", "left_anti").withColumn(
            "measured_on", LIT(None).cast("string"))).select("sample_id", "measured_on")


@query("j7_source_real", "J7", f"""WITH {MEASURED}
SELECT m.sample_id, r.sample_id AS real_id FROM measured m
LEFT JOIN measured r ON r.cell = 'real' AND r.split = m.split AND r.source_clip_id = m.source_clip_id""")
def j7(spark, sf):
    m = measured(spark, sf).select("sample_id", "split", "source_clip_id", "cell")
    return joins.composite_lookup(m, ["split", "source_clip_id"], F.col("cell") == "real",
                                  {"real_id": "sample_id"}).select("sample_id", "real_id")


HOUR = 3_600_000_000


@query("j8_as_of", "J8", """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, value FROM events),
g AS (SELECT user_id, unnest(range(lo, hi + 1)) * 6 * 3600000000 AS us FROM
  (SELECT user_id, min(us) // (6 * 3600000000) AS lo, max(us) // (6 * 3600000000) + 1 AS hi FROM e GROUP BY 1))
SELECT g.user_id, g.us, e.event_id, e.value FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.us >= e.us""")
def j8(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    step = 6 * HOUR
    ends = e.groupBy("user_id").agg(F.floor(F.min("us") / step).alias("lo"),
                                    (F.floor(F.max("us") / step) + 1).alias("hi"))
    grid = ends.select("user_id", F.explode(F.sequence("lo", "hi")).alias("k"))
    grid = grid.select("user_id", (F.col("k") * step).alias("us"))
    return joins.as_of(grid, e, ["user_id"], "us", ["event_id", "value"])




@query("j9_range_join", "J9", """
WITH e AS (SELECT user_id, epoch_us(ts) / 3600000000.0::DOUBLE AS h, event_type <> 'error' AS valid FROM events),
w AS (SELECT user_id, d * 24.0::DOUBLE AS a, d * 24.0::DOUBLE + 48 AS b FROM
  (SELECT user_id, unnest(range(floor(min(h) / 24)::BIGINT, floor(max(h) / 24)::BIGINT + 1)) AS d FROM e GROUP BY user_id))
SELECT w.user_id, w.a, count(*) AS inside, sum(valid::INT)::BIGINT AS valid
FROM w JOIN e ON e.user_id = w.user_id AND h >= a AND h < b GROUP BY 1, 2""")
def j9(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(float(HOUR))).alias("h"),
        (F.col("event_type") != "error").alias("ok"))
    days = e.groupBy("user_id").agg(F.floor(F.min("h") / 24).alias("lo"), F.floor(F.max("h") / 24).alias("hi"))
    w = days.select("user_id", F.explode(F.sequence("lo", "hi")).alias("d"))
    w = w.select("user_id", (F.col("d") * 24.0).alias("a"), (F.col("d") * 24.0 + 48).alias("b"))
    pairs = joins.range_join(e, w, ["user_id"], "h", "a", "b", 24)
    return pairs.groupBy("user_id", "a").agg(F.count(LIT(1)).alias("inside"),
                                             F.sum(F.col("ok").cast("long")).alias("valid"))


@query("j10_lag_join", "J10", f"""WITH {SERIES}, s AS (SELECT clip_id, t, x, valid FROM series),
l AS (SELECT unnest(range(-15, 16)) AS lag)
SELECT a.clip_id, lag, count(*) AS pairs, count(*) FILTER (a.valid AND b.valid) AS n,
  CASE WHEN count(*) >= 10 AND count(*) FILTER (a.valid AND b.valid) > 0
  THEN round(sum(a.x * b.x) FILTER (a.valid AND b.valid), 3) END AS total
FROM s a JOIN l ON true JOIN s b ON b.clip_id = a.clip_id AND b.t = a.t - lag GROUP BY 1, 2""")
def j10(spark, sf):
    out = joins.lag_sums(series(spark, sf), ["clip_id"], "t",
                         {"total": lambda a, b: a["x"] * b["x"]}, "valid", ["x"], 15)
    return out.where("pairs > 0").select("clip_id", "lag", "pairs", "n", F.round("total", 3).alias("total"))


@query("j12_merge_sessions", "J12", f"""
WITH r AS (SELECT event_id AS key, CASE WHEN event_type = 'error' THEN 'retry' ELSE 'done' END AS status, value, {hash_sql('event_id')} % 3 AS h FROM events),
a AS (SELECT key, status, value AS body FROM r WHERE h < 2),
b AS (SELECT key, CASE WHEN key % 5 = 0 THEN 'done' ELSE status END AS status, CASE WHEN key % 7 = 0 THEN value + 1 ELSE value END AS body FROM r WHERE h > 0)
SELECT key, v AS verdict, CASE WHEN v = 'theirs' THEN bs ELSE st END AS status, CASE WHEN v = 'theirs' THEN bb ELSE body END AS body FROM (
  SELECT coalesce(a.key, b.key) AS key, a.status AS st, b.status AS bs, a.body, b.body AS bb,
    CASE WHEN a.key IS NULL THEN 'theirs' WHEN b.key IS NULL THEN 'mine' WHEN a.status = 'retry' AND b.status <> 'retry' THEN 'theirs'
      WHEN b.status = 'retry' THEN 'mine' WHEN a.body = b.body THEN 'same' ELSE 'conflict' END AS v
  FROM a FULL OUTER JOIN b ON a.key = b.key)""")
def j12(spark, sf):
    from framesift.functions.hashing import stable_int

    status = F.when(F.col("event_type") == "error", LIT("retry")).otherwise(LIT("done"))
    r = table(spark, sf, "events").select(
        F.col("event_id").alias("key"), status.alias("status"), F.col("value").alias("body"),
        (stable_int(F.col("event_id")) % 3).alias("h"))
    k = F.col("key")
    mine = r.where("h < 2").drop("h")
    theirs = r.where("h > 0").select(
        "key", F.when(k % 5 == 0, LIT("done")).otherwise(F.col("status")).alias("status"),
        F.when(k % 7 == 0, F.col("body") + 1).otherwise(F.col("body")).alias("body"))
    return joins.merge_sessions(mine, theirs, "key")


@query("b25_sync_correction", "B25", """
WITH s AS (SELECT label, count(*) AS n, (sum(vec_id) % 31 - 15) AS lag FROM embeddings GROUP BY label),
c AS (SELECT label, CASE label % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'few' WHEN 2 THEN 'unreliable' ELSE 'no_clips' END AS status, lag FROM s)
SELECT label::BIGINT AS label, status, (CASE WHEN status IN ('ok','few') THEN lag ELSE 0 END)::BIGINT AS shift,
  CASE WHEN status IN ('ok','few') THEN lag * 40 > 125 OR -lag * 40 > 45 ELSE false END AS noticeable FROM c""")
def b25(spark, sf):
    s = table(spark, sf, "embeddings").groupBy("label").agg((F.sum("vec_id") % 31 - 15).alias("lag"))
    status = F.element_at(F.array(*[LIT(x) for x in ("ok", "few", "unreliable", "no_clips")]),
                          (F.col("label") % 4 + 1).cast("int"))
    shift = sync_correction(F.col("lag"), F.col("status"))
    return s.withColumn("status", status).select(
        F.col("label").cast("long").alias("label"), "status", shift.alias("shift"),
        noticeable(shift).alias("noticeable"))
