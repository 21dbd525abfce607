"""Aggregates."""

from pyspark.sql import functions as F

from framesift.functions.hashing import split_of
from framesift.operators import rollups as R
from framesift.operators import signals as G
from framesift.operators.ordered import positions
from framesift.plans.fixtures import CLIPS, SERIES, clips, event_limit, series, split_sql
from framesift.plans.registry import query
from framesift.session import table

LIT = F.lit

VID = """vid AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch, o_totalprice / 10 AS duration_s, o_totalprice / 100 AS est_mb, o_totalprice / 110 AS size_mb,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS dl, CASE WHEN o_orderpriority < '3' THEN 'done' WHEN o_orderpriority < '5' THEN 'pending' ELSE 'failed' END AS cut, o_orderkey AS video_id FROM orders)"""


def videos(spark, sf):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("batch"), (F.col("o_totalprice") / 10).alias("duration_s"), (F.col("o_totalprice") / 100).alias("est_mb"),
        (F.col("o_totalprice") / 110).alias("size_mb"), F.when(s == "F", LIT("done")).when(s == "O", LIT("pending")).otherwise(LIT("failed")).alias("dl_status"),
        F.when(p < "3", LIT("done")).when(p < "5", LIT("pending")).otherwise(LIT("failed")).alias("cut_status"), F.col("o_orderkey").alias("video_id"))


@query("g1_batch_status", "G1", f"""WITH {VID} SELECT batch, count(*) AS videos, round(sum(duration_s) / 3600, 1) AS hours, round(sum(est_mb) / 1000, 1) AS est_gb, count(*) FILTER (dl = 'done') AS downloaded, count(*) FILTER (dl = 'failed') AS dl_failed,
  round(coalesce(sum(size_mb) FILTER (dl = 'done'), 0) / 1000, 2) AS size_gb, count(*) FILTER (cut = 'done') AS cut, count(*) FILTER (cut = 'failed') AS cut_failed FROM vid GROUP BY 1""")
def g1(spark, sf):
    return R.batch_status(videos(spark, sf))


@query("g2_global_status", "G2", f"""WITH {VID} SELECT 'videos' AS section, dl AS key, count(*) AS n FROM vid GROUP BY 2 UNION ALL SELECT 'cuts', cut, count(*) FROM vid GROUP BY 2
UNION ALL SELECT 'clips', l_returnflag, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'speakers', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def g2(spark, sf):
    v = videos(spark, sf)
    return (R.tally(v, "videos", F.col("dl_status")).unionByName(R.tally(v, "cuts", F.col("cut_status")))
            .unionByName(R.tally(table(spark, sf, "lineitem"), "clips", F.col("l_returnflag")))
            .unionByName(R.tally(table(spark, sf, "customer"), "speakers", F.col("c_mktsegment"))))


@query("g3_review_state", "G3", """WITH n AS (SELECT o_custkey, count(*) AS clips, count(*) FILTER (o_orderstatus = 'F') AS keep FROM orders GROUP BY 1)
SELECT c_custkey AS speaker_id, coalesce(clips, 0) AS clips, coalesce(keep, 0) AS keep, c_custkey % 7 <> 0 AND coalesce(keep, 0) BETWEEN 2 AND 5 AND c_mktsegment <> 'HOUSEHOLD' AS ready FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def g3(spark, sf):
    k = F.col("c_custkey")
    people = table(spark, sf, "customer").select(k.alias("speaker_id"), F.when(k % 7 != 0, LIT("done")).otherwise(LIT("pending")).alias("review"),
                                                 F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).alias("part"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("speaker_id"), F.when(F.col("o_orderstatus") == "F", LIT("keep")).otherwise(LIT("reject")).alias("decision"))
    return R.review_state(people, rows, 2, 5).select("speaker_id", "clips", "keep", "ready")


@query("g4_plan_totals", "G4", f"WITH {VID} SELECT batch, count(*) AS videos, round(sum(duration_s) / 3600, 1) AS hours, round(sum(est_mb) / 1000, 1) AS gb FROM vid GROUP BY 1")
def g4(spark, sf):
    return videos(spark, sf).groupBy("batch").agg(F.count(LIT(1)).alias("videos"), F.round(F.sum("duration_s") / 3600, 1).alias("hours"), F.round(F.sum("est_mb") / 1000, 1).alias("gb"))


@query("g5_speaker_rollup", "G5", """SELECT o_custkey AS speaker_id, count(*) AS clips, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS channels, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS states
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def g5(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").join(o, "l_orderkey")
    return rows.groupBy(F.col("o_custkey").alias("speaker_id")).agg(F.count(LIT(1)).alias("clips"), R.joined_set("l_returnflag").alias("channels"), R.joined_set("o_orderstatus").alias("states"))


@query("g6_split_gender_matrix", "G6", f"WITH c AS (SELECT {split_sql('c_custkey')} AS split, c_custkey % 2 AS g FROM customer) SELECT split, count(*) FILTER (g = 0) AS f, count(*) FILTER (g = 1) AS m FROM c GROUP BY 1")
def g6(spark, sf):
    c = table(spark, sf, "customer").select(split_of(F.col("c_custkey")).alias("split"), F.when(F.col("c_custkey") % 2 == 0, LIT("f")).otherwise(LIT("m")).alias("g"))
    return c.groupBy("split").pivot("g", ["f", "m"]).agg(F.count(LIT(1)))


@query("g7_reject_histogram", "G7", """SELECT user_id, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS rejected FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2) GROUP BY 1""")
def g7(spark, sf):
    out = R.reason_map(table(spark, sf, "events").where("event_type <> 'click'"), ["user_id"], "event_type")
    text = F.transform(F.map_entries("rejected"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("user_id", F.array_join(F.array_sort(text), ",").alias("rejected"))


@query("g8_manifest_counters", "G8", """SELECT 'cell/' || l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'status/' || l_linestatus, count(*) FROM lineitem GROUP BY 1
UNION ALL SELECT 'note/tax', count(*) FROM lineitem WHERE l_tax > 0 UNION ALL SELECT 'note/discount', count(*) FROM lineitem WHERE l_discount > 0""")
def g8(spark, sf):
    notes = F.map_from_entries(F.filter(F.array(
        F.struct(LIT("tax").alias("k"), F.col("l_tax").alias("v")), F.struct(LIT("discount").alias("k"), F.col("l_discount").alias("v"))), lambda e: e["v"] > 0))
    keys = F.concat(F.array(F.concat(LIT("cell/"), "l_returnflag"), F.concat(LIT("status/"), "l_linestatus")), F.transform(F.map_keys(notes), lambda k: F.concat(LIT("note/"), k)))
    return table(spark, sf, "lineitem").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(LIT(1)).alias("n"))


@query("g9_signature_census", "G9", """SELECT source AS encoder, count(l.doc_id) AS found, count(*) AS needed, count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN sha256(lang) END) AS signatures FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def g9(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("lang", 256).alias("sig"))
    found = table(spark, sf, "labels").select("doc_id", LIT(True).alias("hit"))
    return d.join(found, "doc_id", "left").groupBy(F.col("source").alias("encoder")).agg(
        F.count("hit").alias("found"), F.count(LIT(1)).alias("needed"), F.count_distinct(F.when(F.col("hit"), F.col("sig"))).alias("signatures"))


@query("g10_cache_quality", "G10", f"""WITH {SERIES}, c AS (SELECT clip_id, avg(valid::INT) AS r, clip_id % 7 - 3 AS lag, clip_id % 3 = 0 AS fb FROM series GROUP BY 1)
SELECT clip_id % 4 AS cell, round(avg(r), 6) AS mean_valid, count(*) FILTER (r < 0.8) AS under, round(avg((abs(lag) <= 1)::INT), 6) AS within_one, median(lag)::DOUBLE AS median_lag, round(avg(fb::INT), 6) AS fallback FROM c GROUP BY 1""")
def g10(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.avg((F.col("event_type") != "error").cast("double")).alias("r"))
    c = e.withColumn("cell", F.col("clip_id") % 4).withColumn("lag", F.col("clip_id") % 7 - 3)
    med = G.exact_quantiles(c, ["cell"], "lag", {"median_lag": 0.5}).drop("n")
    out = c.groupBy("cell").agg(F.round(F.avg("r"), 6).alias("mean_valid"), R.hits(F.col("r") < 0.8).alias("under"),
                                F.round(F.avg((F.abs("lag") <= 1).cast("double")), 6).alias("within_one"),
                                F.round(F.avg((F.col("clip_id") % 3 == 0).cast("double")), 6).alias("fallback"))
    return out.join(med, "cell").withColumn("median_lag", F.col("median_lag").cast("double"))


@query("g11_seconds_per_job", "G11", """SELECT event_type AS label, count(*) AS done, count(*) FILTER (value > 100) AS skipped, round(avg(sqrt(value)), 6) AS seconds FROM events GROUP BY 1""")
def g11(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(
        F.count(LIT(1)).alias("done"), R.hits(F.col("value") > 100).alias("skipped"), F.round(F.avg(F.sqrt("value")), 6).alias("seconds"))


@query("g13_seen_sets", "G13", f"""WITH {CLIPS} SELECT string_agg(DISTINCT priority, ';' ORDER BY priority) FILTER (priority <> '5-LOW') AS generators, string_agg(DISTINCT status, ';' ORDER BY status) AS voices FROM clips WHERE split = 'train'""")
def g13(spark, sf):
    t = clips(spark, sf).where("split = 'train'")
    return t.select(F.when(F.col("priority") != "5-LOW", F.col("priority")).alias("priority"), "status").agg(
        R.joined_set("priority").alias("generators"), R.joined_set("status").alias("voices"))


@query("g16_leftovers", "G16", """SELECT l_orderkey, l_partkey, CASE WHEN n_regionkey = 1 THEN 'delete' ELSE 'wait' END AS action FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND c_custkey % 3 <> 0""")
def g16(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("speaker_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("speaker_id"), F.col("c_nationkey").alias("batch"),
                                            F.when(F.col("c_custkey") % 3 != 0, LIT("done")).otherwise(LIT("pending")).alias("review"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("batch"), F.when(F.col("n_regionkey") == 1, LIT("drive:x")).otherwise(LIT("local")).alias("location"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", LIT("keep")).otherwise(LIT("reject")).alias("decision"),
                                               F.when(F.col("l_linestatus") == "O", LIT("local")).otherwise(LIT("deleted")).alias("location"))
    rows = rows.join(o, "l_orderkey").join(c.select("speaker_id", "batch"), "speaker_id")
    return R.leftovers(rows, c, n).select("l_orderkey", "l_partkey", "action")


@query("g17_transitions", "G17", """WITH s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'local' WHEN 'O' THEN 'packed' ELSE 'uploaded' END AS st, ['packed','uploaded','deleted'][(o_orderkey % 3 + 1)::INT] AS w, o_totalprice > 100000 AS fin FROM orders),
p AS (SELECT *, CASE WHEN NOT ((st = 'local' AND w = 'packed') OR (st = 'packed' AND w = 'uploaded') OR (st = 'uploaded' AND w = 'deleted')) THEN 'out of order' WHEN w = 'packed' AND NOT fin THEN 'unfinished' END AS problem FROM s)
SELECT k, problem, CASE WHEN problem IS NULL THEN w ELSE st END AS new_status FROM p""")
def g17(spark, sf):
    s = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(s == "F", LIT("local")).when(s == "O", LIT("packed")).otherwise(LIT("uploaded")).alias("st"),
        F.element_at(F.array(LIT("packed"), LIT("uploaded"), LIT("deleted")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("w"), (F.col("o_totalprice") > 100000).alias("fin"))
    return R.transition(rows, "st", "w", F.col("fin")).select("k", "problem", "new_status")


@query("g18_next_unit", "G18", f"""WITH {VID}, loc AS (SELECT DISTINCT batch FROM vid WHERE batch >= '1996-03')
SELECT 'download' AS step, min(batch) AS batch FROM vid WHERE dl IN ('pending', 'failed') AND batch IN (SELECT batch FROM loc) UNION ALL SELECT 'cut', min(batch) FROM vid WHERE dl = 'done' AND cut <> 'done'""")
def g18(spark, sf):
    v = videos(spark, sf)
    local = v.where("batch >= '1996-03'").select("batch").distinct()
    a = v.where(F.col("dl_status").isin("pending", "failed")).join(local, "batch", "left_semi").agg(F.min("batch").alias("batch"))
    b = v.where("dl_status = 'done' AND cut_status <> 'done'").agg(F.min("batch").alias("batch"))
    return a.select(LIT("download").alias("step"), "batch").unionByName(b.select(LIT("cut").alias("step"), "batch"))


@query("g20_test_use", "G20", """WITH u AS (SELECT event_id, event_type AS model, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth, floor(value) AS stamp FROM events),
d AS (SELECT DISTINCT event_type AS model, floor(value) AS stamp FROM events WHERE event_id % 5 = 0) SELECT event_id, model, nth FROM u WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.model = u.model AND d.stamp = u.stamp)""")
def g20(spark, sf):
    """A handful of models share the whole log, so the counter is an ordered position with ranges."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), "ts", F.floor("value").alias("stamp"))
    done = e.where("event_id % 5 = 0").select("model", "stamp")
    nth = positions(e, ["model"], ["ts", "event_id"], "nth").withColumn("nth", F.col("nth") + 1)
    return nth.join(done, ["model", "stamp"], "left_anti").select("event_id", "model", "nth")
