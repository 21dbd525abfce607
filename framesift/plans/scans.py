"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from framesift.functions.hashing import split_of
from framesift.plans.fixtures import split_sql
from framesift.plans.registry import query
from framesift.session import table, workspace
from framesift.sources import inputs, ledger, manifest, measures

TASKS = ["click", "error", "purchase", "signup", "view"]


@query("a1_read_manifest", "A1", """
SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS text_length, sha256(text) AS digest
FROM documents""")
def a1(spark, sf):
    docs, path = table(spark, sf, "documents"), workspace(spark, "manifest")
    manifest.write_manifest(docs, path)
    return manifest.read_manifest(spark, path, docs.schema).select(
        "doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("text_length"),
        F.sha2("text", 256).alias("digest"),
    )


@query("a2_write_manifest", "A2", """
SELECT lang, count(*) AS n, round(sum(s), 6) AS total FROM (
  SELECT lang, CASE WHEN n_chars % 7 = 0 THEN 'nan'::DOUBLE ELSE n_chars / 3.0::DOUBLE END AS s
  FROM documents) WHERE NOT isnan(s) GROUP BY lang""")
def a2(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang",
        F.when(F.col("n_chars") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 3.0)
        .cast("double").alias("s"),
    )
    path = workspace(spark, "manifest")
    manifest.write_manifest(docs.where(manifest.finite("s")), path)
    back = manifest.read_manifest(spark, path, docs.schema)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 6).alias("total"))


@query("a3_read_inputs", "A3", """
WITH raw AS (SELECT url, page_id,
    list_value('1',' 2 ','N','nhieu','nhiều','Many','multi','2+','three')[(page_id % 9 + 1)::INT] AS given
  FROM pages WHERE page_id % 11 <> 0 AND page_id % 13 <> 0),
n AS (SELECT url, lower(trim(given)) AS g, page_id FROM raw)
SELECT url, CASE WHEN g IN ('1','2') THEN g WHEN g = 'three' THEN NULL ELSE 'n' END AS speakers,
       CASE WHEN g = 'three' THEN 'speakers must be 1, 2 or n: three' ELSE '' END AS reason
FROM n""")
def a3(spark, sf):
    pages = table(spark, sf, "pages")
    spellings = F.array(*[F.lit(x) for x in
                          ("1", " 2 ", "N", "nhieu", "nhiều", "Many", "multi", "2+", "three")])
    given = F.element_at(spellings, (F.col("page_id") % 9 + 1).cast("int"))
    line = F.concat_ws(",", F.when(F.col("page_id") % 13 == 0, F.lit(" ")).otherwise(F.col("url")),
                       given, F.lit("note"))
    text = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line)
    path = workspace(spark, "inputs")
    pages.select(text.alias("value")).write.text(path)
    good, bad = inputs.read_inputs(spark, path)
    return good.select("url", "speakers", F.lit("").alias("reason")).unionByName(
        bad.select("url", F.lit(None).cast("string").alias("speakers"), "reason"))


@query("a4_load_curves", "A4", """
WITH c AS (SELECT vec_id, CASE WHEN label = 9 THEN (embedding::DOUBLE[])[1:30]
                               ELSE (embedding::DOUBLE[])[1:31] END AS cos, label FROM embeddings)
SELECT vec_id::VARCHAR AS sample_id, 31::BIGINT AS n, round(cos[16], 6) AS at_zero,
       CASE WHEN label = 3 THEN 1 ELSE 0 END::BIGINT AS missing
FROM c WHERE len(cos) = 31""")
def a4(spark, sf):
    v = table(spark, sf, "embeddings")
    values = F.transform(
        F.slice(F.col("embedding").cast("array<double>"), 1,
                F.when(F.col("label") == 9, F.lit(30)).otherwise(F.lit(31))),
        lambda x, i: F.when((F.col("label") == 3) & (i == 4), F.lit(None)).otherwise(x))
    body = F.struct(F.map_from_arrays(
        F.array(F.col("vec_id").cast("string")), F.array(F.struct(values.alias("cos")))).alias("samples"))
    texts = v.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
    curves = measures.load_curves(texts, "body")
    return curves.select(
        "sample_id", F.size("curve").cast("long").alias("n"),
        F.round(F.col("curve")[15], 6).alias("at_zero"),
        F.size(F.filter("curve", F.isnan)).cast("long").alias("missing"))


@query("a5_export_csv", "A5",
       "SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label, 'yes' AS embedding FROM embeddings")
def a5(spark, sf):
    path = workspace(spark, "csv")
    view = ledger.csv_view(table(spark, sf, "embeddings"))
    view.write.option("header", True).csv(path)
    return (spark.read.option("header", True)
            .schema("vec_id string, embedding string, label string").option("enforceSchema", "false")
            .csv(path))


def task_scores(spark, sf):
    """Latest value per user and event type as (sample_id, task, score)."""
    events = table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    latest = ledger.upsert(events, ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("task"),
                         F.col("value").alias("score"))


WIDE = "wide AS (SELECT user_id AS sample_id, " + ", ".join(
    f"coalesce(arg_max(value, (ts, event_id)) FILTER (event_type = '{t}'), 'nan'::DOUBLE) AS video_{t}"
    for t in TASKS) + " FROM events GROUP BY user_id)"


@query("a6_save_predictions", "A6", f"WITH {WIDE} SELECT * FROM wide")
def a6(spark, sf):
    path = workspace(spark, "predictions")
    wide = measures.save_predictions(task_scores(spark, sf), TASKS)
    wide.withColumn("variant", F.lit("clean")).write.partitionBy("variant").parquet(path)
    return spark.read.parquet(path).where(F.col("variant") == "clean").drop("variant")


@query("a7_load_predictions", "A7", f"""WITH {WIDE}
SELECT sample_id, video_click AS score FROM wide WHERE NOT isnan(video_click)""")
def a7(spark, sf):
    wide = measures.save_predictions(task_scores(spark, sf), TASKS)
    return measures.load_predictions(wide, "click").where(measures.known_score("score"))


@query("a8_write_batch_list", "A8", """
SELECT strftime(o_orderdate, '%Y-%m') AS batch, o_orderkey AS clip_id, c_name AS name,
       round(o_totalprice / 60, 1) AS minutes, c_custkey AS input_id
FROM orders JOIN customer ON o_custkey = c_custkey""")
def a8(spark, sf):
    videos = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("batch"), F.col("o_orderkey").alias("clip_id"),
        F.round(F.col("o_totalprice") / 60, 1).alias("minutes"), F.col("o_custkey").alias("input_id"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("input_id"),
                                                 F.col("c_name").alias("name"))
    path = workspace(spark, "batches")
    ledger.write_batch_lists(videos.repartition("batch"), people, "input_id", "batch", path)
    schema = "input_id long, clip_id long, minutes double, name string, batch string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("a9_export_bundle", "A9", f"""
SELECT o_custkey AS speaker_id, any_value(CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END) AS gender,
       any_value({split_sql('o_custkey')}) AS split, count(*) AS clips,
       string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS channels,
       count(DISTINCT o_orderkey) AS videos
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY o_custkey""")
def a9(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("clip_id"))
    videos = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("speaker_id"),
        F.col("o_orderstatus").alias("channel"), split_of(F.col("o_custkey")).alias("split"))
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("speaker_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"))
    path = workspace(spark, "bundle")
    ledger.export_bundle(lines, videos, people, path)
    return spark.read.parquet(f"{path}/speakers")


@query("a10_selected_parts", "A10", """
SELECT year(o_orderdate)::VARCHAR AS dataset_part, count(*) AS clips,
       round(sum(o_totalprice), 2) AS total, 0::BIGINT AS shared
FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1""")
def a10(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    path = workspace(spark, "parts")
    part = F.year("o_orderdate").cast("string")
    rows = orders.withColumn("dataset_part", part).drop("o_orderdate")
    manifest.write_manifest(rows, path, ["dataset_part"])
    schema = orders.drop("o_orderdate").schema
    rows = manifest.read_parts(spark, path, schema, ["1996", "1998"])
    shared = manifest.media_in_two_parts(rows, "o_orderkey").agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("dataset_part").agg(
        F.count(F.lit(1)).alias("clips"), F.round(F.sum("o_totalprice"), 2).alias("total"),
    ).withColumn("shared", shared)


@query("a11_finalize", "A11", """
WITH rows AS (SELECT l_orderkey AS key, l_orderkey * 1000000 + l_partkey AS sample_id, l_quantity AS q
              FROM lineitem),
dec AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F')
SELECT key, 'kept' AS state, count(*) AS n, sum(q) AS total FROM rows
WHERE key IN (SELECT o_orderkey FROM orders) AND sample_id % 3 <> 0 GROUP BY key
UNION ALL
SELECT o_orderkey, 'missing', 0, NULL FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def a11(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    ident = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), ident.alias("sample_id"), F.col("l_quantity").alias("q"))
    decisions = lines.select("sample_id").distinct().select(
        "sample_id",
        F.when(F.col("sample_id") % 3 == 0, F.lit("drop")).otherwise(F.lit("keep")).alias("decision"))
    kept, missing = manifest.finalize(jobs, lines, decisions)
    done = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"))
    return done.select("key", F.lit("kept").alias("state"), "n", "total").unionByName(
        missing.select("key", F.lit("missing").alias("state"), F.lit(0).cast("long").alias("n"),
                       F.lit(None).cast("double").alias("total")))


@query("a12_upsert", "A12", """
SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value, max(ts)::VARCHAR IS NOT NULL AS known,
       arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def a12(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts", "event_id")
    return ledger.upsert(rows, ["key"], ["ts", "event_id"]).select(
        "key", "value", F.col("ts").isNotNull().alias("known"), "event_id")


@query("a13_backup", "A13", """
SELECT s AS snapshot, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation,
  (VALUES ('20240102_000000'), ('20240103_000000')) v(s)""")
def a13(spark, sf):
    nation, path = table(spark, sf, "nation"), workspace(spark, "backup")
    for stamp in ("20240101_000000", "20240102_000000", "20240103_000000"):
        ledger.backup(nation, path, stamp)
    return ledger.kept_snapshots(spark, path, 2).select(
        "snapshot", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("a14_event_log", "A14", """
SELECT event_type AS step, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2""")
def a14(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("ts").alias("at"), F.col("event_type").alias("step"), F.col("props").alias("message"))
    path = workspace(spark, "log")
    ledger.log_events(rows, path)
    return spark.read.parquet(path).groupBy(
        "step", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


ROOTS = ["src3", "src1", "src7", "src2"]


@query("a15_cache_lookup", "A15", """
WITH found AS (SELECT sha256(text) AS digest, min(list_position(['src3','src1','src7','src2'], source)) AS pos
               FROM documents WHERE source IN ('src3','src1','src7','src2') GROUP BY 1)
SELECT w.digest, ['src3','src1','src7','src2'][coalesce(pos, 1)] AS root, pos IS NOT NULL AS found
FROM (SELECT DISTINCT sha256(text) AS digest FROM documents) w LEFT JOIN found USING (digest)""")
def a15(spark, sf):
    files = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"),
                                                 F.col("source").alias("root"))
    return measures.first_root(files, files.select("digest").distinct(), "digest", ROOTS)


@query("a16_ledger_scan", "A16", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 200000
  AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_custkey, o_orderkey""")
def a16(spark, sf):
    return (
        table(spark, sf, "orders")
        .where(F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(100000, 200000))
        .where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        .select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", "o_orderkey")
    )


@query("a17_register_inputs", "A17", """
WITH known AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg
               FROM customer WHERE c_acctbal > 0)
SELECT c_custkey AS k, 'insert' AS action, NULL::VARCHAR AS known_value FROM customer
WHERE c_custkey NOT IN (SELECT k FROM known)
UNION ALL SELECT c_custkey, 'conflict', seg FROM customer JOIN known ON c_custkey = k
WHERE seg <> c_mktsegment""")
def a17(spark, sf):
    people = table(spark, sf, "customer")
    incoming = people.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    seg = F.when(F.col("c_custkey") % 10 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))
    known = people.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), seg.alias("seg"))
    fresh, clash = inputs.register_inputs(known, incoming, "k", "seg")
    return fresh.select("k", F.lit("insert").alias("action"),
                        F.lit(None).cast("string").alias("known_value")).unionByName(
        clash.select("k", F.lit("conflict").alias("action"), "known_value"))
