"""Labels from measurements."""

from pyspark.sql import functions as F

from framesift.functions import spans as S
from framesift.functions.rules import LIPSYNC_CELLS
from framesift.operators import labels as L
from framesift.operators import metrics as M
from framesift.plans.fixtures import MEASURED, measured
from framesift.plans.grading import auc_sql
from framesift.plans.registry import query

LIT = F.lit
RULES = {"negative_quantile": 0.5, "positive_quantile": 0.6, "sharpness_quantile": 0.1, "min_reals": 10}


def rows(spark, sf):
    """Measured samples; every 17th has no distance curve. Sham rows are mismatched by construction,
    generated lips cover the whole clip or one second of it."""
    m = measured(spark, sf).withColumn("dist", F.when(F.col("sample_id") % 17 != 0, F.col("dist")))
    one = F.array(S.span(LIT(1.0), LIT(2.0)))
    whole = F.array(S.span(LIT(0.0), LIT(4.0)))
    visual = F.when(~F.col("cell").isin(LIPSYNC_CELLS), S.no_spans()).when(F.col("kind") == "partial", one).otherwise(whole)
    return m.withColumn("visual", visual).withColumn(
        "av_mismatch", F.when(F.col("cell") == "sham", F.array(S.span(LIT(0.5), LIT(1.0)))).otherwise(S.no_spans()))


def judged(spark, sf):
    r = rows(spark, sf)
    thr = L.thresholds(r, RULES)
    sibling = F.when(F.col("kind") == "partial", F.col("sample_id") - 1).otherwise(F.col("sample_id"))
    return L.with_regions(r, thr, sibling)


ROWS = f"""{MEASURED}, lr AS (SELECT * REPLACE (CASE WHEN sample_id % 17 <> 0 THEN dist END AS dist) FROM measured),
sh AS (SELECT *, list_max(cos) - list_median(cos) AS sa, list_median(dist) - list_min(dist) AS ss FROM lr),
th AS (SELECT quantile_cont(-cos[16], 0.5) AS na, quantile_cont(-cos[16], 0.6) AS pa, quantile_cont(sa, 0.1) AS qa, count(cos[16]) AS ra,
  quantile_cont(dist[16], 0.5) AS nd, quantile_cont(dist[16], 0.6) AS pd, quantile_cont(ss, 0.1) AS qd, count(dist[16]) AS rd FROM sh WHERE split = 'train' AND cell = 'real'),
reg AS (SELECT sh.*, CASE WHEN dist IS NOT NULL THEN sa >= qa AND ss >= qd END AS measurable FROM sh, th),
jn AS (SELECT r.*, s.measurable AS sm, s.cos AS sc, s.dist AS sd, g.cos AS gc, g.dist AS gd, g.measurable AS gm FROM reg r
  LEFT JOIN reg s ON s.cell = 'real' AND s.split = r.split AND s.source_clip_id = r.source_clip_id AND s.measurable IS NOT NULL
  LEFT JOIN reg g ON g.sample_id = CASE WHEN r.kind = 'partial' THEN r.sample_id - 1 ELSE r.sample_id END AND g.measurable IS NOT NULL)"""


def state_sql(c: str, d: str, k: str) -> str:
    a, b = f"(-{c}[(16 - {k})::INT])", f"{d}[(16 - {k})::INT]"
    return f"CASE WHEN {a} > pa AND {b} > pd THEN 1 WHEN {a} <= na AND {b} <= nd THEN 0 END"


def real_sql(k: str, mode: str = "measured") -> str:
    inner = f"CASE WHEN sm THEN {state_sql('sc', 'sd', k)} END" if mode == "measured" else "NULL"
    return f"(CASE WHEN abs({k}) <= 1 THEN 0 ELSE {inner} END)"


def gen_sql(k: str, mode: str = "measured") -> str:
    return f"(CASE WHEN sm AND gm IS NOT NULL THEN {state_sql('gc', 'gd', k)} END)" if mode == "measured" else "(NULL::INT)"


def video_sql(k: str, mode: str = "measured") -> str:
    g, r = gen_sql(k, mode), real_sql(k, mode)
    return f"""(CASE WHEN cell = 'sham' THEN 1 WHEN cell IN ('source', 'donor', 'both') THEN CASE WHEN kind = 'partial' THEN
      CASE WHEN {g} = 1 OR {r} = 1 THEN 1 WHEN {g} IS NULL OR {r} IS NULL THEN NULL ELSE 0 END ELSE {g} END ELSE {r} END)::BIGINT"""


@query("l1_curve_numbers", "L1", f"""WITH {ROWS} SELECT sample_id, round(sa, 6) AS sharp_cos, round(ss, 6) AS sharp_dist, round(-cos[16 - 3], 6) AS bad_cos_3, round(dist[16 + 4], 6) AS bad_dist_m4, NULL::DOUBLE AS outside FROM sh""")
def l1(spark, sf):
    r = rows(spark, sf)
    av = L.badness("avhubert", F.col("cos"))
    return r.select(
        "sample_id", F.round(L.sharpness("avhubert", F.col("cos")), 6).alias("sharp_cos"), F.round(L.sharpness("syncnet", F.col("dist")), 6).alias("sharp_dist"),
        F.round(L.at_shift(av, 3), 6).alias("bad_cos_3"), F.round(L.at_shift(F.col("dist"), -4), 6).alias("bad_dist_m4"), L.at_shift(av, 16).alias("outside"))


@query("g19_thresholds", "G19", f"""WITH {ROWS} SELECT 'avhubert' AS meter, ra AS reals, round(na, 6) AS negative, round(pa, 6) AS positive, round(qa, 6) AS sharpness FROM th
UNION ALL SELECT 'syncnet', rd, round(nd, 6), round(pd, 6), round(qd, 6) FROM th""")
def g19(spark, sf):
    t = L.thresholds(rows(spark, sf), RULES)
    return t.select("meter", "reals", *[F.round(c, 6).alias(c) for c in ("negative", "positive", "sharpness")])


@query("l2_region", "L2", f"WITH {ROWS} SELECT sample_id, measurable FROM reg")
def l2(spark, sf):
    r = rows(spark, sf)
    return L.region(r, L.thresholds(r, RULES)).select("sample_id", "measurable")


@query("l3_measured_state", "L3", f"""WITH {ROWS} SELECT sample_id, k::BIGINT AS k, (CASE WHEN measurable THEN {state_sql('cos', 'dist', 'k')} END)::BIGINT AS state FROM reg, th, (VALUES (0), (5)) v(k)""")
def l3(spark, sf):
    r = rows(spark, sf)
    thr = L.thresholds(r, RULES)
    reg = L.region(r, thr)
    bads = {m: F.col(f"bad_{m}") for m in L.METERS}
    pair = F.explode(F.array(*[F.struct(LIT(k).cast("long").alias("k"), F.when(F.col("measurable"), L.measured_state(bads, k)).alias("state")) for k in (0, 5)])).alias("p")
    return reg.select("sample_id", pair).select("sample_id", "p.k", "p.state")


@query("l4_video_state", "L4", f"""WITH {ROWS} SELECT sample_id, {real_sql('4')}::BIGINT AS real_4, {gen_sql('0')}::BIGINT AS gen_0, {video_sql('0')} AS video_0, {video_sql('4')} AS video_4 FROM jn, th""")
def l4(spark, sf):
    j = judged(spark, sf)
    return j.select("sample_id", L.real_state(4).alias("real_4"), L.generated_state(0).alias("gen_0"),
                    L.video_state(0).alias("video_0"), L.video_state(4).alias("video_4"))


@query("l5_frame_targets", "L5", f"""WITH {ROWS}, f AS (SELECT jn.*, th.*, f AS frame, CASE WHEN cell = 'sham' THEN greatest(0, least((f + 1) * 0.04, 1.0) - greatest(f * 0.04, 0.5)) / 0.04 ELSE 0 END::DOUBLE AS content,
    cell IN ('source','both') AND (kind = 'full' OR (f >= 25 AND f < 50)) AS made FROM jn, th, range(0, 100) r(f)),
s AS (SELECT sample_id, frame, content, CASE WHEN made THEN {gen_sql('0')} ELSE {real_sql('0')} END AS st FROM f)
SELECT sample_id, round(sum(CASE WHEN content > 1e-9 THEN greatest(coalesce(st, 0), content) ELSE coalesce(st, 0) END), 4) AS total, count(*) FILTER (content > 1e-9 OR st IS NOT NULL) AS valid FROM s GROUP BY 1""")
def l5(spark, sf):
    j = judged(spark, sf)
    frames = j.withColumn("frame", F.explode(F.sequence(LIT(0), LIT(99))))
    a = F.col("frame") * 0.04

    def cover(spans):
        return F.aggregate(spans, LIT(0.0), lambda acc, s: acc + S.overlap(a, a + 0.04, s["a"], s["b"]) / 0.04)

    content = F.round(cover(F.col("av_mismatch")), 9)
    made = F.col("cell").isin(LIPSYNC_CELLS) & (cover(F.col("visual")) > 0.5)
    value, valid = L.frame_state(made, content, L.real_state(0), L.generated_state(0))
    return frames.select("sample_id", value.alias("v"), valid.alias("ok")).groupBy("sample_id").agg(
        F.round(F.sum("v"), 4).alias("total"), F.count(F.when(F.col("ok"), 1)).alias("valid"))


@query("l6_annotate_modes", "L6", f"""WITH {ROWS} SELECT sample_id, 'construction' AS mode, (cell = 'sham')::BIGINT AS label FROM jn UNION ALL SELECT sample_id, 'mask_lipsync', {video_sql('0', 'mask')} FROM jn, th
UNION ALL SELECT sample_id, 'measured', {video_sql('0')} FROM jn, th""")
def l6(spark, sf):
    j = judged(spark, sf)
    mode = F.explode(F.array(*[F.struct(LIT(m).alias("mode"), L.video_state(0, m).alias("label")) for m in ("construction", "mask_lipsync", "measured")])).alias("m")
    return j.select("sample_id", mode).select("sample_id", "m.mode", "m.label")


@query("l7_video_targets", "L7", f"WITH {ROWS} SELECT sample_id, coalesce({video_sql('0')}, -1) AS mismatch, (cell IN ('source','both'))::BIGINT AS visual FROM jn, th")
def l7(spark, sf):
    j = judged(spark, sf)
    return j.select("sample_id", F.coalesce(L.video_state(0), LIT(-1).cast("long")).alias("mismatch"), (F.size("visual") > 0).cast("long").alias("visual"))


@query("l8_mismatch_intervals", "L8", f"""WITH {ROWS} SELECT sample_id, CASE WHEN cell = 'sham' THEN '0.5000-1.0000' WHEN cell IN ('source','both') THEN CASE {gen_sql('0')} WHEN 1 THEN CASE WHEN kind = 'partial' THEN '1.0000-2.0000' ELSE '0.0000-4.0000' END WHEN 0 THEN '' END ELSE '' END AS spans FROM jn, th""")
def l8(spark, sf):
    j = judged(spark, sf)
    made = F.size("visual") > 0
    spans = L.mismatch_spans(made, L.generated_state(0), F.col("av_mismatch"), F.col("visual"))
    return j.select("sample_id", spans.alias("spans")).select("sample_id", S.as_text(F.col("spans")).alias("spans"))


@query("g14_mismatch_counts", "G14", f"""WITH {ROWS}, v AS (SELECT split || '/' || CASE WHEN cell IN ('source','both') THEN cell || '/' || (label % 3)::VARCHAR ELSE cell END AS key, {video_sql('0')} AS s FROM jn, th)
SELECT key, count(*) FILTER (s = 1) AS one, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s IS NULL) AS mask FROM v GROUP BY 1""")
def g14(spark, sf):
    j = judged(spark, sf)
    cell = F.when(F.col("cell").isin(LIPSYNC_CELLS), F.concat_ws("/", "cell", F.col("label") % 3)).otherwise(F.col("cell"))
    v = j.select(F.concat_ws("/", "split", cell).alias("key"), L.video_state(0).alias("s"))
    return v.groupBy("key").agg(F.count(F.when(F.col("s") == 1, 1)).alias("one"), F.count(F.when(F.col("s") == 0, 1)).alias("zero"), F.count(F.when(F.col("s").isNull(), 1)).alias("mask"))


@query("g15_label_by_shift", "G15", f"""WITH {ROWS}, v AS (SELECT k, {real_sql('k')} AS s FROM jn, th, range(-5, 8) r(k) WHERE split = 'train' AND cell = 'real')
SELECT k::BIGINT AS k, count(*) FILTER (s = 1) AS one, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s IS NULL) AS mask FROM v GROUP BY 1""")
def g15(spark, sf):
    j = judged(spark, sf)
    pair = F.explode(F.array(*[F.struct(LIT(k).cast("long").alias("k"), L.video_state(k).alias("s")) for k in range(-5, 8)])).alias("p")
    v = j.where("split = 'train' AND cell = 'real'").select(pair).select("p.*")
    return v.groupBy("k").agg(F.count(F.when(F.col("s") == 1, 1)).alias("one"), F.count(F.when(F.col("s") == 0, 1)).alias("zero"), F.count(F.when(F.col("s").isNull(), 1)).alias("mask"))


@query("m25_lag0_audit", "M25", f"""WITH {MEASURED}, b AS (SELECT split, cell, kind, label % 3 AS g, -cos[16] AS s FROM measured), p AS (SELECT split, g::VARCHAR AS grp, s FROM b WHERE cell IN ('source','both') AND kind = 'full'),
u AS (SELECT split, grp, s, 1 AS y FROM p UNION ALL SELECT d.split, d.grp, b.s, 0 FROM (SELECT DISTINCT split, grp FROM p) d JOIN b ON b.split = d.split AND b.cell = 'real'), c AS (SELECT split, grp, count(*) AS k FROM p GROUP BY 1, 2)
SELECT a.split, a.grp AS "group", k AS n, round(auc, 6) AS auc, auc NOT BETWEEN 0.3 AND 0.7 AS flag FROM {auc_sql('u', 'split, grp', 's')} a JOIN c USING (split, grp)""")
def m25(spark, sf):
    b = measured(spark, sf).withColumn("s", L.at_shift(L.badness("avhubert", F.col("cos")), 0))
    made = F.col("cell").isin(LIPSYNC_CELLS) & (F.col("kind") == "full")
    out = M.versus_reals(b, ["split"], "s", made, F.col("cell") == "real", F.array((F.col("label") % 3).cast("string")))
    return out.select("split", "group", "n", F.round("auc", 6).alias("auc"), (~F.col("auc").between(0.3, 0.7)).alias("flag"))
