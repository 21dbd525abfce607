"""Projections, predicates and validation (B1–B27; B8 and B27 live with their inputs)."""

from pyspark.sql import functions as F

from framesift.functions import rules as R
from framesift.functions import spans as S
from framesift.functions.hashing import split_of
from framesift.operators import filters
from framesift.operators.ordered import previous
from framesift.plans.fixtures import CLIPS, SAMPLES, SPANS, clips, samples, spans, split_sql
from framesift.plans.registry import query
from framesift.plans.scans import TASKS, WIDE, task_scores
from framesift.session import table
from framesift.sources import manifest, measures

LIT = F.lit


def nth(options, index):
    return F.element_at(F.array(*[LIT(o) for o in options]), (index + 1).cast("int"))


@query("b1_valid_id", "B1", r"""
SELECT value, regexp_full_match(value, '[A-Za-z0-9_-]+') AS ok, count(*) AS n FROM (
  SELECT source AS value FROM documents UNION ALL SELECT p_name FROM part) GROUP BY 1, 2""")
def b1(spark, sf):
    values = table(spark, sf, "documents").select(F.col("source").alias("value")).unionByName(
        table(spark, sf, "part").select(F.col("p_name").alias("value")))
    counted = values.groupBy("value").agg(F.count(LIT(1)).alias("n"))
    return counted.withColumn("ok", R.valid_id(F.col("value")))


@query("b2_bundle_path", "B2", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS rel FROM pages),
v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN rel WHEN 1 THEN '/' || rel WHEN 2 THEN 'a/../' || rel
  WHEN 3 THEN 'C:/' || rel WHEN 4 THEN 'a\' || rel ELSE 'clips/..b/' || rel END AS path FROM p)
SELECT page_id, path, page_id % 6 IN (0, 5) AS safe FROM v""")
def b2(spark, sf):
    rel = F.regexp_replace("url", "^https?://[^/]+/", "")
    path = F.concat(nth(["", "/", "a/../", "C:/", "a\\", "clips/..b/"], F.col("page_id") % 6), rel)
    return table(spark, sf, "pages").select("page_id", path.alias("path")).withColumn(
        "safe", R.safe_bundle_path(F.col("path")))


@query("b3_validate_bundle", "B3", f"""
WITH m AS (SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 97 = 1 THEN 'bad id' ELSE 'c' || (o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END)::VARCHAR END AS clip_id,
    CASE WHEN o_orderkey % 89 = 2 THEN NULL ELSE {split_sql('o_custkey')} END AS split,
    CASE WHEN o_orderkey % 83 = 3 THEN ' ' ELSE 's' || o_custkey::VARCHAR END AS source_id,
    CASE WHEN o_orderkey % 79 = 4 THEN 'reject' ELSE 'keep' END AS review,
    CASE WHEN o_orderkey % 73 = 5 THEN -1.0 WHEN o_orderkey % 71 = 6 THEN 'nan'::DOUBLE ELSE o_totalprice / 1e5 END::DOUBLE AS d,
    o_totalprice / 1e5 + CASE WHEN o_orderkey % 67 = 7 THEN 0.5 ELSE 0.0 END::DOUBLE AS e,
    CASE WHEN o_orderkey % 61 = 8 THEN 'raw/x.mp4' ELSE 'clips/x.mp4' END AS video,
    sha256((o_orderkey - CASE WHEN o_orderkey % 59 = 9 THEN 1 ELSE 0 END)::VARCHAR) AS h FROM orders),
f AS (SELECT *, row_id <> min(row_id) OVER (PARTITION BY clip_id) AS dup_id,
             row_id <> min(row_id) OVER (PARTITION BY h) AS dup_h,
             (SELECT arg_min(split IS NOT NULL, row_id) FROM m) AS fs FROM m)
SELECT row_id, CASE WHEN clip_id LIKE '% %' OR dup_id THEN 'invalid or duplicate clip_id'
  WHEN (split IS NOT NULL) <> fs THEN 'missing or invalid split' WHEN trim(source_id) = '' THEN 'source_id required'
  WHEN review <> 'keep' THEN 'not reviewed' WHEN isnan(d) OR d <= 0 THEN 'invalid duration'
  WHEN NOT (0 < e) OR abs(e - d) > 0.25 THEN 'invalid source interval'
  WHEN video NOT LIKE 'clips/%' THEN 'unsafe video path' WHEN dup_h THEN 'duplicate content' END AS reason FROM f""")
def b3(spark, sf):
    k = F.col("o_orderkey")

    def mod(n, r):
        return k % n == r

    d = F.col("o_totalprice") / 1e5
    m = table(spark, sf, "orders").select(
        k.alias("row_id"),
        F.when(mod(97, 1), LIT("bad id")).otherwise(
            F.concat(LIT("c"), (k - mod(50, 1).cast("int")).cast("string"))).alias("clip_id"),
        F.when(~mod(89, 2), split_of(F.col("o_custkey"))).alias("split"),
        F.when(mod(83, 3), LIT(" ")).otherwise(F.concat(LIT("s"), F.col("o_custkey"))).alias("source_id"),
        F.when(mod(79, 4), LIT("reject")).otherwise(LIT("keep")).alias("review_decision"),
        LIT("reviewed_match").alias("sync_status"), LIT(None).cast("string").alias("variant"),
        F.when(mod(73, 5), LIT(-1.0)).when(mod(71, 6), LIT(float("nan"))).otherwise(d).alias("duration_s"),
        LIT(0.0).alias("source_start_s"), (d + F.when(mod(67, 7), 0.5).otherwise(0.0)).alias("source_end_s"),
        F.when(mod(61, 8), LIT("raw/x.mp4")).otherwise(LIT("clips/x.mp4")).alias("video"),
        F.sha2((k - mod(59, 9).cast("int")).cast("string"), 256).alias("sha256"))
    first = m.agg(F.min_by(F.col("split").isNotNull(), F.col("row_id"))).scalar()
    m = filters.repeats(m, "clip_id", "row_id", "dup_id")
    m = filters.repeats(m, "sha256", "row_id", "dup_media")
    return m.select("row_id", R.bundle_issue(F.col, F.col("dup_id"), F.col("dup_media"), first).alias("reason"))


@query("b4_validate_annotations", "B4", """
WITH c AS (SELECT o_orderkey AS k, o_totalprice / 1e4 AS d FROM orders)
SELECT k AS clip_id, NOT (k % 11 = 0 OR k % 7 = 0 OR k % 5 = 0) AS ok FROM c""")
def b4(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_totalprice") / 1e4
    known = F.array(S.span(F.when(k % 11 == 0, LIT(float("nan"))).otherwise(LIT(0.0)), d * 0.4),
                    S.span(d * 0.5, d * F.when(k % 7 == 0, 1.2).otherwise(1.0)))
    positive = F.array(S.span(d * 0.1, d * F.when(k % 5 == 0, 0.45).otherwise(0.3)))
    return table(spark, sf, "orders").select(
        k.alias("clip_id"), R.annotations_ok(known, positive, d).alias("ok"))


@query("b5_validate_rows", "B5", """
SELECT o_orderkey AS sample_id, CASE
  WHEN o_orderkey % 53 = 1 THEN 'label or review' WHEN o_orderkey % 47 = 2 THEN 'provenance required'
  WHEN o_orderkey % 43 = 3 AND o_orderkey % 3 <> 0 THEN 'label differs from modality flags'
  WHEN o_orderkey % 3 = 2 AND o_orderkey % 37 = 5 THEN 'synthetic modality without spans'
  WHEN o_orderkey % 3 = 2 AND o_orderkey % 31 = 6 THEN 'invalid modality spans'
  WHEN o_orderkey % 3 = 2 AND o_orderkey % 29 = 7 THEN 'union differs'
  WHEN o_orderkey % 3 = 1 AND o_orderkey % 23 = 8 THEN 'fake without spans'
  WHEN o_orderkey % 41 = 4 THEN 'media hash required' END AS reason FROM orders""")
def b5(spark, sf):
    """k % 3: 0 real, 1 weak fake (spans unknown), 2 visual and audio fake with spans."""
    k, d = F.col("o_orderkey"), LIT(4.0)
    kind = k % 3
    flags = {"a": F.when(kind == 2, True).when(kind == 0, False),
             "v": F.when(kind == 2, True).when(kind == 0, False)}
    visual = (
        F.when(kind == 0, S.no_spans()).when(kind == 1, S.unknown_spans())
        .when(k % 37 == 5, S.no_spans())
        .when(k % 31 == 6, F.array(S.span(LIT(3.0), LIT(4.5))))
        .otherwise(F.array(S.span(LIT(0.5), LIT(1.5)), S.span(LIT(2.0), LIT(2.5)))))
    audio = F.when(kind == 0, S.no_spans()).when(kind == 1, S.unknown_spans()).otherwise(
        F.array(S.span(LIT(1.0), LIT(1.8))))
    fake = (
        F.when(kind == 0, S.no_spans())
        .when(kind == 1, F.when(k % 23 == 8, S.no_spans()))
        .when(k % 29 == 7, F.array(S.span(LIT(0.5), LIT(2.5))))
        .otherwise(F.array(S.span(LIT(0.5), LIT(1.8)), S.span(LIT(2.0), LIT(2.5)))))
    label = F.when(k % 53 == 1, 2).otherwise((kind != 0).cast("int"))
    # A wrong label needs both flags known to be caught, so give the weak fakes flags there too.
    flip = (k % 43 == 3) & (kind != 0)
    rows = table(spark, sf, "orders").select(
        k.alias("row_id"), k.cast("string").alias("sample_id"), LIT("train").alias("split"),
        label.alias("label"), LIT("keep").alias("review_status"), d.alias("duration_s"),
        LIT("s").alias("source_id"), F.when(k % 47 != 2, LIT("g")).alias("generator"),
        F.when(flip, False).otherwise(flags["a"]).alias("synthetic_audio"),
        F.when(flip, False).otherwise(flags["v"]).alias("synthetic_visual"),
        audio.alias("audio_fake_intervals"), visual.alias("visual_fake_intervals"),
        fake.alias("fake_intervals"),
        F.when(k % 41 != 4, F.sha2(k.cast("string"), 256)).alias("sha256"))
    return rows.select(F.col("row_id").alias("sample_id"), R.generated_issue(F.col).alias("reason"))


@query("b6_check_intervals", "B6", f"""
WITH {SPANS}, o AS (SELECT *, lag(b) OVER (PARTITION BY clip_id ORDER BY a, b, kind) AS prev FROM spans)
SELECT clip_id, count(*) AS n, sum(CASE WHEN NOT (0 <= a AND a < b AND b <= 125 + 1e-6 AND a >= coalesce(prev, 0))
  THEN 1 ELSE 0 END)::BIGINT AS broken FROM o GROUP BY clip_id""")
def b6(spark, sf):
    rows = previous(spans(spark, sf), ["clip_id"], ["a", "b", "kind"], {"prev": "b"})
    good = ((F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= 125 + 1e-6)
            & (F.col("a") >= F.coalesce("prev", LIT(0.0))))
    return rows.groupBy("clip_id").agg(F.count(LIT(1)).alias("n"),
                                       F.sum((~good).cast("long")).alias("broken"))


@query("b7_content_crosses_splits", "B7", """
SELECT sha256(text) AS digest, min(source) AS first_group, max(source) AS last_group, count(*) AS n
FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def b7(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return filters.crossing(docs, "digest", "source")


PART_META = """meta AS (SELECT p_partkey AS k,
  ['', 'is_live', '', 'was_live', '', 'post_live', '', ''][(p_partkey % 8 + 1)::INT] AS live,
  ['public', 'private', 'unlisted', '', NULL, 'public', 'public'][(p_partkey % 7 + 1)::INT] AS avail,
  p_retailprice * (p_size - 1) AS duration, [25.0, 23.976, 24.9, 30.0, 60.0][(p_partkey % 5 + 1)::INT]::DOUBLE AS fps,
  [1280, 1280, 640, 720, 1920, 1280, 1280][(p_size % 7 + 1)::INT] AS w,
  [720, 720, 480, 1280, 1080, 720, 720][(p_size % 7 + 1)::INT] AS h,
  ['vi', 'vi-VN', 'en', '', NULL, 'VI'][(p_partkey % 6 + 1)::INT] AS lang,
  CASE WHEN p_partkey % 17 = 3 THEN '' ELSE '22' END AS vf, p_partkey % 13 <> 2 AS orig FROM part)"""


def part_meta(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("k"), nth(["", "is_live", "", "was_live", "", "post_live", "", ""], k % 8).alias("live_status"),
        nth(["public", "private", "unlisted", "", None, "public", "public"], k % 7).alias("availability"),
        (F.col("p_retailprice") * (size - 1)).alias("duration_s"),
        nth([25.0, 23.976, 24.9, 30.0, 60.0], k % 5).alias("native_fps"),
        nth([1280, 1280, 640, 720, 1920, 1280, 1280], size % 7).alias("v_width"),
        nth([720, 720, 480, 1280, 1080, 720, 720], size % 7).alias("v_height"),
        nth(["vi", "vi-VN", "en", "", None, "VI"], k % 6).alias("a_language"),
        F.when(k % 17 == 3, LIT("")).otherwise(LIT("22")).alias("v_format_id"),
        LIT("140").alias("a_format_id"), (k % 13 != 2).alias("audio_is_original"))


@query("b9_metadata_issue", "B9", f"""WITH {PART_META}
SELECT k, CASE WHEN live IN ('is_live','is_upcoming','post_live') THEN 'live stream (' || live || ')'
  WHEN coalesce(avail, '') NOT IN ('', 'public', 'unlisted') THEN 'availability ' || avail
  WHEN NOT duration BETWEEN 30 AND 43200 THEN 'duration ' || round_even(duration, 0)::BIGINT::VARCHAR || 's outside 30s-12h'
  WHEN fps < 24.5 THEN 'fps ' || printf('%.2f', fps) || ' < 25' WHEN vf = '' THEN 'no format'
  WHEN h > w THEN 'vertical video' WHEN least(w, h) < 720 THEN 'short side ' || least(w, h)::VARCHAR
  WHEN least(w, h) > 720 THEN 'no smaller format, short side ' || least(w, h)::VARCHAR
  WHEN NOT orig THEN 'dubbed track'
  WHEN coalesce(lang, '') <> '' AND lower(lang) NOT LIKE 'vi%' THEN 'audio language ' || lower(lang) END AS reason FROM meta""")
def b9(spark, sf):
    return part_meta(spark, sf).select("k", R.metadata_issue(F.col).alias("reason"))


@query("b10_quality_issue", "B10", f"""WITH {PART_META}
SELECT k, CASE WHEN k % 19 = 0 OR fps IS NULL THEN 'missing fps/resolution metadata'
  WHEN fps < 24.5 THEN 'fps ' || printf('%.2f', fps) WHEN h > w THEN 'vertical video'
  WHEN least(w, h) < 720 THEN 'short side ' || least(w, h)::VARCHAR END AS reason FROM meta""")
def b10(spark, sf):
    width = F.when(F.col("k") % 19 != 0, F.col("v_width"))
    return part_meta(spark, sf).select(
        "k", R.quality_issue(F.col("native_fps"), width, F.col("v_height")).alias("reason"))


@query("b11_estimate_mb", "B11", """
WITH s AS (SELECT l_orderkey, l_partkey, l_quantity * 60 AS d,
  CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 100 END AS vm,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity * 20 END AS vk,
  CASE WHEN l_linestatus = 'F' THEN l_tax * 100 END AS am,
  CASE WHEN l_discount > 0.04 THEN 128.0::DOUBLE END AS ak FROM lineitem)
SELECT l_orderkey, l_partkey, round(CASE WHEN coalesce(vm, vk * d / 8 / 1000) IS NULL THEN 500.0::DOUBLE * d / 3600
  ELSE coalesce(vm, vk * d / 8 / 1000) + coalesce(am, CASE WHEN ak <> 0 THEN ak * d / 8 / 1000 END, 0) END, 1) AS mb FROM s""")
def b11(spark, sf):
    d = F.col("l_quantity") * 60
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", R.estimate_mb(
        d, F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice") / 100),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 20),
        F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 100),
        F.when(F.col("l_discount") > 0.04, LIT(128.0))).alias("mb"))


@query("b12_describe", "B12", """
WITH f AS (SELECT p_partkey AS k, i, CASE WHEN (p_partkey + i) % 3 = 0 THEN 'none' ELSE 'avc1' END AS vc,
    CASE WHEN (p_partkey + i) % 4 = 0 THEN NULL ELSE 'mp4a' END AS ac, 320 * ((p_partkey + 5 * i) % 5 + 1) AS w,
    180 * ((p_partkey + 7 * i) % 6 + 1) AS h, (24 + (p_partkey * i) % 7)::DOUBLE AS fps,
    CASE WHEN i % 2 = 0 THEN 'vi' ELSE 'en' END AS lang FROM part, range(0, 10) r(i) WHERE i <= p_size % 9)
SELECT k, arg_min(w, (-least(w, h), i)) FILTER (vc <> 'none') AS max_width,
  arg_min(h, (-least(w, h), i)) FILTER (vc <> 'none') AS max_height,
  coalesce(max(fps) FILTER (vc <> 'none'), 0) AS native_fps,
  coalesce(arg_min(h > w, (-least(w, h), i)) FILTER (vc <> 'none'), false) AS vertical,
  coalesce('f' || (min(i) FILTER (vc <> 'none'))::VARCHAR, '') AS v_format_id,
  coalesce('f' || (min(i) FILTER (ac IS NOT NULL))::VARCHAR, '') AS a_format_id,
  nullif(count(DISTINCT lang) FILTER (vc = 'none' AND ac IS NOT NULL), 0) AS audio_track_count,
  count(DISTINCT lang) FILTER (vc = 'none' AND ac IS NOT NULL) <= 1
    OR coalesce(min(i) FILTER (ac IS NOT NULL) % 4 = 1, false) AS audio_is_original
FROM f GROUP BY k""")
def b12(spark, sf):
    k = F.col("p_partkey")
    formats = F.transform(F.sequence(LIT(0), F.col("p_size") % 9), lambda i: F.struct(
        F.when((k + i) % 3 == 0, LIT("none")).otherwise(LIT("avc1")).alias("vcodec"),
        F.when((k + i) % 4 != 0, LIT("mp4a")).alias("acodec"),
        (320 * ((k + 5 * i) % 5 + 1)).alias("width"), (180 * ((k + 7 * i) % 6 + 1)).alias("height"),
        (24 + (k * i) % 7).cast("double").alias("fps"),
        F.when(i % 2 == 0, LIT("vi")).otherwise(LIT("en")).alias("language"),
        F.when(i % 4 == 1, LIT("Original (default)")).alias("format_note"),
        F.concat(LIT("f"), i.cast("string")).alias("format_id")))
    rows = table(spark, sf, "part").select(k.alias("k"), formats.alias("formats"))
    return rows.select("k", R.describe_formats(F.col("formats"), F.col("formats")).alias("d")).select("k", "d.*")


@query("b13_classify_url", "B13", """
WITH u AS (SELECT page_id, page_id % 9 AS m, substr(md5(url), 1, 11) AS vid, regexp_extract(url, 'example[.]([a-z]+)', 1) AS tld FROM pages)
SELECT page_id, CASE m WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'playlist' WHEN 3 THEN 'channel'
    WHEN 4 THEN 'channel' WHEN 5 THEN 'video' END AS kind,
  CASE WHEN m IN (0, 1, 5) THEN 'https://www.youtube.com/watch?v=' || vid
    WHEN m = 2 THEN 'https://www.youtube.com/playlist?list=PL' || tld
    WHEN m = 3 THEN 'https://www.youtube.com/@' || tld || '/videos'
    WHEN m = 4 THEN 'https://www.youtube.com/channel/' || tld || '/videos' END AS canonical FROM u""")
def b13(spark, sf):
    vid = F.substring(F.md5("url"), 1, 11)
    tld = F.regexp_extract("url", "example[.]([a-z]+)", 1)
    forms = F.array(
        F.concat(LIT(" https://m.youtube.com/watch?list=x&v="), vid), F.concat(LIT("http://youtu.be/"), vid, LIT("?t=1")),
        F.concat(LIT("https://youtube.com/playlist?list=PL"), tld), F.concat(LIT("https://www.youtube.com/@"), tld, LIT("/shorts")),
        F.concat(LIT("https://www.youtube.com/channel/"), tld), F.concat(LIT("https://WWW.youtube.com/shorts/"), vid),
        F.concat(LIT("https://www.youtube.com/watch?v=short"), LIT("")), F.col("url"), LIT("https://www.youtube.com/user"))
    rows = table(spark, sf, "pages").select(
        "page_id", R.classify_url(F.element_at(forms, (F.col("page_id") % 9 + 1).cast("int"))).alias("c"))
    return rows.select("page_id", "c.kind", "c.canonical")


@query("b14_error_class", "B14", r"""
WITH e AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'HTTP Error 503 ' WHEN 1 THEN 'Sign in to confirm you''re not a bot '
   WHEN 2 THEN 'Worker failed: boom' || chr(10) WHEN 3 THEN 'x not detect face ' WHEN 4 THEN 'Video unavailable '
   WHEN 5 THEN 'read timed out ' ELSE '' END || text AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, 'confirm you.re not a bot') THEN 'bot_check'
   WHEN regexp_matches(t, '(?i)private|unavailable|removed|terminated|members|age|copyright|not available|deleted') THEN 'unavailable'
   WHEN regexp_matches(t, 'HTTP Error (403|429|5\d\d)|timed out|Connection (reset|aborted)|IncompleteRead') THEN 'transient'
   ELSE 'error' END AS download_error,
  CASE WHEN regexp_matches(t, 'Face not detected|Missing MuseTalk face|Invalid face bbox|not detect face|''mask_sharp''') THEN 'face'
   WHEN starts_with(t, 'Worker failed: ') THEN 'generator_error' END AS job_error FROM e""")
def b14(spark, sf):
    k = F.col("doc_id") % 7
    head = nth(["HTTP Error 503 ", "Sign in to confirm you're not a bot ", "Worker failed: boom\n",
                "x not detect face ", "Video unavailable ", "read timed out ", ""], k)
    text = F.concat(head, F.col("text"))
    colored = F.concat(LIT("\x1b[31m"), F.substring(text, 1, 6), LIT("\x1b[0m"), F.substring(text, 7, 1 << 30))
    return table(spark, sf, "documents").select(
        "doc_id", R.download_error(colored).alias("download_error"), R.job_error(text)["kind"].alias("job_error"))


@query("b15_clean_metrics", "B15", """
SELECT event_id, name, v FROM (SELECT event_id, name, CASE name WHEN 'raw' THEN value
  WHEN 'log' THEN CASE WHEN value < 5 THEN NULL ELSE round(ln(value), 6) END
  ELSE CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE WHEN event_type = 'view' THEN 'inf'::DOUBLE ELSE value * 2 END END AS v
  FROM events, (VALUES ('raw'), ('log'), ('ratio')) n(name)) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)""")
def b15(spark, sf):
    v = F.col("value")
    wide = table(spark, sf, "events").select(
        "event_id", v.alias("raw"), F.when(v >= 5, F.round(F.log(v), 6)).alias("log"),
        F.when(F.col("event_type") == "error", LIT(float("nan")))
        .when(F.col("event_type") == "view", LIT(float("inf"))).otherwise(v * 2).alias("ratio"))
    long = wide.unpivot("event_id", ["raw", "log", "ratio"], "name", "v")
    return long.where(F.col("v").isNotNull() & manifest.finite("v"))


@query("b16_cell_labels", "B16", f"""
WITH {CLIPS}, c AS (SELECT clip_id, ['real','sham','voice','source','donor','both'][(clip_id % 6 + 1)::INT] AS cell,
    CASE WHEN status = 'F' THEN 'full' ELSE 'partial' END AS kind, round(duration_s, 1) AS d,
    round(duration_s, 1) * 0.25 AS a, round(duration_s, 1) * 0.5 AS b FROM clips),
t AS (SELECT *, printf('%.4f-%.4f', 0.0, d) AS whole, printf('%.4f-%.4f', a, b) AS part,
    CASE WHEN kind = 'full' THEN printf('%.4f-%.4f', 0.0, d) ELSE printf('%.4f-%.4f', a, b) END AS touched FROM c)
SELECT clip_id, (cell NOT IN ('real', 'sham'))::BIGINT AS label,
  CASE WHEN cell IN ('real','sham') THEN '' ELSE touched END AS fake,
  CASE WHEN cell IN ('source','donor','both') THEN touched ELSE '' END AS visual,
  CASE WHEN cell = 'voice' THEN touched WHEN cell = 'both' THEN part ELSE '' END AS audio,
  CASE WHEN cell IN ('sham','voice') THEN touched ELSE '' END AS mismatch FROM t""")
def b16(spark, sf):
    cell = nth(R.CELLS, F.col("clip_id") % 6)
    kind = F.when(F.col("status") == "F", LIT("full")).otherwise(LIT("partial"))
    d = F.round("duration_s", 1)
    part = F.array(S.span(d * 0.25, d * 0.5))
    rows = clips(spark, sf).select("clip_id", R.cell_labels(cell, kind, d, part).alias("l"))
    return rows.select("clip_id", F.col("l.label"),
                       *[S.as_text(F.col(f"l.{n}")).alias(n) for n in ("fake", "visual", "audio", "mismatch")])


@query("b17_variant_selection", "B17", f"""WITH {CLIPS}
SELECT clip_id, 'c288' AS variant FROM clips WHERE split = 'test'
UNION ALL SELECT clip_id, 'pr' FROM clips WHERE status IN ('O', 'P')
UNION ALL SELECT clip_id, 'all' FROM clips""")
def b17(spark, sf):
    c = clips(spark, sf).select("clip_id", "split", "status")

    def pick(name, **lists):
        chosen = c.where(filters.selection(F.col("split"), F.col("status"), **lists))
        return chosen.select("clip_id", LIT(name).alias("variant"))

    return pick("c288", splits=["test"]).unionByName(pick("pr", cells=["O", "P"])).unionByName(pick("all"))


@query("b18_wanted", "B18", f"""WITH {CLIPS},
c AS (SELECT clip_id, ['real','sham','voice','source','donor','both'][(clip_id % 6 + 1)::INT] AS cell, status FROM clips)
SELECT cell, count(*) AS n FROM c WHERE cell = 'real' OR (cell IN ('source','donor','both') AND status = 'F') GROUP BY cell""")
def b18(spark, sf):
    c = clips(spark, sf).select(
        nth(R.CELLS, F.col("clip_id") % 6).alias("cell"),
        F.when(F.col("status") == "F", LIT("full")).otherwise(LIT("partial")).alias("kind"))
    return c.where(filters.wanted(F.col("cell"), F.col("kind"), R.LIPSYNC_CELLS)).groupBy("cell").agg(
        F.count(LIT(1)).alias("n"))


@query("b19_smoke_subset", "B19", f"""WITH {CLIPS}
SELECT clip_id, speaker_id, split FROM (SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY speaker_id) AS r FROM clips)
WHERE r <= 5""")
def b19(spark, sf):
    rows = clips(spark, sf).select("clip_id", "speaker_id", "split")
    return filters.smoke_subset(rows, "split", "speaker_id", 5).select("clip_id", "speaker_id", "split")


@query("b20_known_labels", "B20", """
SELECT doc_id AS sample_id, task, y FROM (SELECT doc_id, task, CASE task WHEN 'ai' THEN quality WHEN 'visual' THEN toxic
  ELSE CASE WHEN quality = toxic THEN quality END END::BIGINT AS y
  FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('ai'), ('visual'), ('mismatch')) t(task)) WHERE y IS NOT NULL""")
def b20(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "sample_id")
    q, t = F.col("quality"), F.col("toxic")
    return filters.task_labels(docs.join(lab, "sample_id", "left"), ["sample_id"],
                               {"ai": q, "visual": t, "mismatch": F.when(q == t, q)})


@query("b21_gate_subset", "B21", f"""WITH {SAMPLES},
seen AS (SELECT DISTINCT speaker_id FROM samples WHERE split = 'train' AND y = 1 AND sample_id % 3 = 0)
SELECT sample_id, 'unseen' AS subset FROM samples WHERE split <> 'train' AND (y = 0 OR speaker_id NOT IN (SELECT speaker_id FROM seen))
UNION ALL SELECT sample_id, 'cell' FROM samples WHERE y = 0 OR cell = 'en'""")
def b21(spark, sf):
    s = samples(spark, sf)
    seen = s.where("split = 'train' AND y = 1 AND sample_id % 3 = 0")
    unseen = filters.gate_subset(s.where("split <> 'train'"), "y", "speaker_id", seen=seen)
    one = filters.gate_subset(s, "y", "speaker_id", cell=("cell", "en"))
    return unseen.select("sample_id", LIT("unseen").alias("subset")).unionByName(
        one.select("sample_id", LIT("cell").alias("subset")))


@query("b22_resolution_gate", "B22", """
WITH s AS (SELECT p_partkey AS k, p_size * 15 AS side, p_retailprice AS v,
  CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 2 END AS a FROM part)
SELECT k, side < 360 AND a IS NOT NULL AS gated, CASE WHEN side < 360 AND a IS NOT NULL THEN NULL ELSE v END AS visual, a AS audio,
  CASE WHEN side < 360 AND a IS NOT NULL THEN a ELSE v * 3 END AS ai FROM s""")
def b22(spark, sf):
    v = F.col("p_retailprice")
    scores = {"visual": v, "audio": F.when(F.col("p_partkey") % 4 != 0, v / 2), "ai": v * 3}
    out, gated = R.resolution_gate(F.col("p_size") * 15, 360, scores)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), gated.alias("gated"),
                                           *[c.alias(t) for t, c in out.items()])


@query("b23_task_scores", "B23", f"""WITH {WIDE}
SELECT sample_id, greatest(video_click, video_view) AS ai, video_click AS visual, video_view AS audio FROM wide""")
def b23(spark, sf):
    wide = measures.save_predictions(task_scores(spark, sf), TASKS)
    return wide.select("sample_id", F.greatest("video_click", "video_view").alias("ai"),
                       F.col("video_click").alias("visual"), F.col("video_view").alias("audio"))


@query("b24_ready_speakers", "B24", """
SELECT c_custkey AS speaker_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, n AS kept
FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey
WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_mktsegment <> 'HOUSEHOLD' AND n BETWEEN 2 AND 5""")
def b24(spark, sf):
    k = F.col("c_custkey")
    people = table(spark, sf, "customer").select(
        k.alias("speaker_id"), F.when(k % 2 == 0, LIT("F")).otherwise(LIT("M")).alias("gender"),
        F.when(k % 7 != 0, LIT("done")).otherwise(LIT("pending")).alias("review"),
        F.when(k % 11 == 0, LIT("x")).otherwise(LIT("")).alias("merged_into"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).alias("part"))
    done = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("speaker_id"),
        F.when(F.col("o_orderstatus") == "F", LIT("keep")).otherwise(LIT("reject")).alias("decision"))
    return filters.ready_speakers(people, done, 2, 5).select("speaker_id", "gender", "kept")


@query("b26_status_propagation", "B26", """
WITH s AS (SELECT o_orderkey, ['ok','few','unreliable','no_clips'][(o_orderkey % 4 + 1)::INT] AS st FROM orders)
SELECT l_orderkey, l_partkey, CASE WHEN st IN ('unreliable','no_clips') THEN 'reject' ELSE l_linestatus END AS decision,
  CASE st WHEN 'ok' THEN CASE WHEN l_returnflag = 'R' THEN 'jump_suspect' ELSE '' END
    WHEN 'few' THEN CASE WHEN l_returnflag = 'R' THEN 'jump_suspect,sync_few' ELSE 'sync_few' END
    ELSE CASE WHEN l_returnflag = 'R' THEN 'jump_suspect,sync_unreliable' ELSE 'sync_unreliable' END END AS flags
FROM lineitem JOIN s ON l_orderkey = o_orderkey""")
def b26(spark, sf):
    status = nth(["ok", "few", "unreliable", "no_clips"], F.col("o_orderkey") % 4)
    videos = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), status.alias("st"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag")
    bad = F.col("st").isin("unreliable", "no_clips")
    flag = F.when(bad, LIT("sync_unreliable")).when(F.col("st") == "few", LIT("sync_few"))
    own = F.when(F.col("l_returnflag") == "R", LIT("jump_suspect")).otherwise(LIT(""))
    return lines.join(videos, "l_orderkey").select(
        "l_orderkey", "l_partkey", F.when(bad, LIT("reject")).otherwise(F.col("l_linestatus")).alias("decision"),
        R.add_flag(own, flag).alias("flags"))
