"""Streaming twins (T1–T7) and plug-in points."""

from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.operators import metrics as M
from framesift.plans.fixtures import SAMPLES, SERIES, VECTORS, samples, vectors
from framesift.operators import living as L
from framesift.plans.grading import auc_sql
from framesift.plans.identity import LIVING_RULES, living_clips, living_sql
from framesift.plans.registry import query
from framesift.plans.signals import TRACK
from framesift.plans.spans import HOURS, WINDOWS
from framesift.session import table, workspace
from framesift.streaming import jobs as J
from framesift.streaming import plugins as U

LIT = F.lit


@query("t1_sessions", "T1", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def t1(spark, sf):
    out = J.newest(J.run_to_end(J.sessions(J.event_stream(spark, sf, "1 day"), "user_id", "12 hours"), "sessions", "complete"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n")


@query("t2_blocks", "T2", f"""WITH {HOURS}, f AS (SELECT clip_id, floor(h / 6)::BIGINT AS block, arg_min(value, (h, event_id)) AS value, count(*) - 1 AS skipped FROM hours GROUP BY 1, 2),
g AS (SELECT clip_id, unnest(range(min(block), max(block) + 1)) AS block FROM f GROUP BY clip_id)
SELECT clip_id AS user_id, block, coalesce(value, 0) AS value, coalesce(skipped, 0) AS skipped FROM g LEFT JOIN f USING (clip_id, block)""")
def t2(spark, sf):
    out = J.newest(J.run_to_end(J.blocks(J.event_stream(spark, sf, "1 day"), "user_id", "6 hours", "value", "event_id"), "blocks", "complete"))
    found = out.select("user_id", F.floor((F.unix_micros("start") / LIT(3.6e9) - 473352) / 6).alias("block"), "value", "skipped")
    ends = found.groupBy("user_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    grid = ends.select("user_id", F.explode(F.sequence("lo", "hi")).alias("block"))
    return grid.join(found, ["user_id", "block"], "left").fillna({"value": 0.0, "skipped": 0})


@query("t3_sliding_windows", "T3", """WITH w AS (SELECT user_id, event_type <> 'error' AS ok, epoch_us(ts) // 86400000000 AS d FROM events), x AS (SELECT user_id, ok, unnest([d - 1, d]) AS s FROM w)
SELECT user_id, s * 86400000000 AS start, count(*) AS inside, sum(ok::INT)::BIGINT AS valid FROM x GROUP BY 1, 2""")
def t3(spark, sf):
    good = F.col("event_type") != "error"
    out = J.newest(J.run_to_end(J.sliding(J.event_stream(spark, sf, "1 day"), "user_id", "48 hours", "24 hours", good), "sliding", "complete"))
    return out.select("user_id", F.unix_micros("start").alias("start"), "inside", "valid")


@query("t4_continuity", "T4", f"WITH RECURSIVE {TRACK} SELECT clip_id AS user_id, event_id, valid FROM rows_ JOIN f USING (clip_id, t)")
def t4(spark, sf):
    k, x = F.col("event_id"), F.sqrt("value")
    e = J.event_stream(spark, sf, "1 day").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") != "error", 1).otherwise((k % 2) * 2).cast("int").alias("faces"),
        (k % 17 != 0).alias("ok_geometry"), (x * 4).alias("x"), (x * 2).alias("y"), (40 + x).alias("w"), (40 + x).alias("h"))
    return J.run_to_end(J.track(e, "user_id", "user_id long"), "track", "append").drop("batch")


@query("t5_dedup", "T5", "SELECT DISTINCT user_id, event_type, floor(value / 10)::BIGINT AS bucket FROM events")
def t5(spark, sf):
    e = J.event_stream(spark, sf, "60 days").withColumn("bucket", F.floor(F.col("value") / 10))
    kept = e.dropDuplicatesWithinWatermark(["user_id", "event_type", "bucket"]).select("user_id", "event_type", "bucket")
    return J.run_to_end(kept, "dedup", "append").drop("batch")


@query("t6_registry_update", "T6", f"WITH {VECTORS} SELECT label, count(*) AS n, round(sum(v[1]), 6) AS first, round(sum(v[64]), 6) AS last FROM vectors GROUP BY 1")
def t6(spark, sf):
    points = J.table_stream(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), V.doubles(F.col("embedding")).alias("v"))
    out = J.registry_stream(points, "label", "v", 64)
    return out.select("label", "n", F.round(F.col("s")[0], 6).alias("first"), F.round(F.col("s")[63], 6).alias("last"))


@query("t6_living_registry", "T6", f"""{living_sql()} SELECT vec_id AS clip_id, speaker, CASE WHEN speaker IS NULL THEN 'unassigned' ELSE how END AS assign FROM c JOIN al USING (k)""")
def t6_living(spark, sf):
    """The rounds of V4 as micro-batches: one file arrives per round."""
    clips, path = living_clips(spark, sf), workspace(spark, "arrivals")
    for n in range(3):
        clips.where(F.col("round") == n).coalesce(1).write.parquet(f"{path}/n={n}")
    stream = spark.readStream.schema(clips.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return L.identify_stream(stream, L.Store(spark), 64, LIVING_RULES).select("clip_id", "speaker", "assign")


@query("t7_status_counters", "T7", "SELECT event_type AS step, epoch_us(ts) // 86400000000 * 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2")
def t7(spark, sf):
    counts = J.event_stream(spark, sf, "1 day").groupBy(F.col("event_type").alias("step"), F.window("ts", "1 day").alias("w")).agg(F.count(LIT(1)).alias("n"))
    out = J.latest(J.run_to_end(counts.select("step", F.col("w.start").alias("day"), "n"), "counters", "update"), ["step", "day"])
    return out.select("step", F.unix_micros("day").alias("day"), "n")


@query("u1_reader_plugin", "U1", "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS line_breaks FROM documents")
def u1(spark, sf):
    reader = U.with_reader(lambda text: text.count("\n"))
    return table(spark, sf, "documents").select("doc_id", reader("text").alias("line_breaks"))


@query("u2_group_plugin", "U2", "SELECT conv_id, turn, length(text)::DOUBLE AS size FROM conversations")
def u2(spark, sf):
    """A clip-sized group (one turn) handed to a caller's function."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return U.per_group(rows, ["conv_id", "turn"], lambda pdf: pdf.assign(size=pdf["text"].str.len().astype(float))[["conv_id", "turn", "size"]],
                       "conv_id long, turn long, size double")


@query("u3_aggregate_plugins", "U3", f"""WITH {SAMPLES}, {VECTORS} SELECT 'auc/' || cell AS name, round(auc, 6) AS value FROM {auc_sql('samples', 'cell')} UNION ALL SELECT 'sum/' || label::VARCHAR, round(sum(v[2]), 6) FROM vectors GROUP BY label""")
def u3(spark, sf):
    a = M.auc(samples(spark, sf), ["cell"], "score", "y").select(F.concat(LIT("auc/"), "cell").alias("name"), F.round("auc", 6).alias("value"))
    s = vectors(spark, sf).groupBy("label").agg(V.vector_sum("v", 64).alias("s"))
    return a.unionByName(s.select(F.concat(LIT("sum/"), "label").alias("name"), F.round(F.col("s")[1], 6).alias("value")))


@query("u4_table_plugin", "U4", f"WITH {SERIES}, {WINDOWS} SELECT clip_id, start, least(start + 24, n) AS stop FROM wins")
def u4(spark, sf):
    U.register_windows(spark)
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("clip_id")).agg(F.count(LIT(1)).alias("n"))
    return spark.sql("SELECT c.clip_id, w.start, w.stop FROM {n} c, LATERAL clip_windows(c.n, 24, 12) w", n=n)
