"""Detector evaluation."""

from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.functions.hashing import sha1_byte, stable_int
from framesift.operators import metrics as M
from framesift.operators import signals as G
from framesift.operators.filters import gate_subset
from framesift.plans.fixtures import SAMPLES, SERIES, VECTORS, event_limit, hash_sql, samples, series, vectors
from framesift.plans.registry import query
from framesift.plans.signals import COUPLING, HALVES, VSER, two_series, vector_series
from framesift.session import table

LIT = F.lit


def r6(name):
    return F.round(name, 6).alias(name)


def auc_sql(source: str, keys: str, score: str = "score", y: str = "y", w: str = "1.0::DOUBLE", name: str = "auc") -> str:
    """Weighted Mann–Whitney AUC with mid-ranks."""
    return f"""(SELECT {keys}, p + n AS n, CASE WHEN p > 0 AND n > 0 THEN u / (p * n) END AS {name} FROM (
      SELECT {keys}, sum(pos * (below - neg / 2)) AS u, sum(pos) AS p, sum(neg) AS n FROM (
        SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY s) AS below FROM (
          SELECT {keys}, {score} AS s, sum(CASE WHEN {y} = 1 THEN {w} ELSE 0.0::DOUBLE END) AS pos, sum(CASE WHEN {y} = 0 THEN {w} ELSE 0.0::DOUBLE END) AS neg
          FROM {source} WHERE {y} IS NOT NULL GROUP BY {keys}, {score})) GROUP BY {keys}))"""


def roc_sql(source: str, keys: str, score: str = "score", y: str = "y") -> str:
    return f"""(SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER k AS p, sum(neg) OVER k AS n,
        lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS i FROM (
      SELECT {keys}, {score} AS score, count(*) FILTER ({y} = 1)::DOUBLE AS pos, count(*) FILTER ({y} = 0)::DOUBLE AS neg FROM {source} GROUP BY {keys}, {score})
      WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), k AS (PARTITION BY {keys}))"""


TASKED = """tasked AS (SELECT sample_id, speaker_id, cell, split, score, task, CASE WHEN task = 'ai' THEN y ELSE y2 END AS y
  FROM samples, (VALUES ('ai'), ('toxic')) t(task))"""


def tasked(spark, sf):
    s = samples(spark, sf)
    pair = F.explode(F.array(F.struct(LIT("ai").alias("task"), F.col("y").alias("y")),
                             F.struct(LIT("toxic").alias("task"), F.col("y2").alias("y")))).alias("p")
    return s.select("sample_id", "speaker_id", "cell", "split", "score", pair).select(
        "sample_id", "speaker_id", "cell", "split", "score", "p.task", "p.y")


@query("flagship_speaker_report", "B20 M1 M2 M9", f"""WITH {SAMPLES}, {TASKED},
w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY task, speaker_id) AS w FROM tasked),
g AS (SELECT *, 'cell/' || cell AS grp FROM tasked)
SELECT task, 'all' AS "group", n::BIGINT AS n, round(auc, 6) AS auc FROM {auc_sql('tasked', 'task')}
UNION ALL SELECT task, 'speaker balanced', round(n)::BIGINT, round(auc, 6) FROM {auc_sql('w', 'task', w='w')}
UNION ALL SELECT task, grp, n::BIGINT, round(auc, 6) FROM {auc_sql('g', 'task, grp')}""")
def flagship(spark, sf):
    t = M.speaker_weight(tasked(spark, sf), ["task"], "speaker_id")

    def group(name, weight):
        return F.struct(name.alias("group"), weight.alias("w"))

    groups = F.explode(F.array(
        group(LIT("all"), LIT(1.0)), group(LIT("speaker balanced"), F.col("weight")),
        group(F.concat(LIT("cell/"), "cell"), LIT(1.0)))).alias("g")
    rows = t.select("task", "score", "y", groups).select("task", "score", "y", "g.*")
    out = M.auc(rows, ["task", "group"], "score", "y", F.col("w"))
    return out.select("task", "group", F.round("n").cast("long").alias("n"), r6("auc"))


@query("m1_auc", "M1", f"""WITH {SERIES}, e AS (SELECT *, (event_type = 'purchase')::INT AS y FROM series)
SELECT clip_id, n, round(auc, 6) AS auc FROM {auc_sql('e', 'clip_id', 'value')} UNION ALL SELECT -1, n, round(auc, 6) FROM {auc_sql('(SELECT 0 AS z, * FROM e)', 'z', 'value')}""")
def m1(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), "value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    own = M.auc(e, ["clip_id"], "value", "y")
    whole = M.auc(e.withColumn("clip_id", LIT(-1).cast("long")), ["clip_id"], "value", "y")
    return own.unionByName(whole).select("clip_id", "n", r6("auc"))


@query("m2_speaker_balanced_auc", "M2", f"""WITH {SAMPLES}, {TASKED}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY task, speaker_id) AS w FROM tasked)
SELECT task, round(n, 6) AS n, round(auc, 6) AS auc FROM {auc_sql('w', 'task', w='w')}""")
def m2(spark, sf):
    t = M.speaker_weight(tasked(spark, sf), ["task"], "speaker_id")
    return M.auc(t, ["task"], "score", "y", F.col("weight")).select("task", r6("n"), r6("auc"))


EV = "e AS (SELECT user_id AS k, value AS score, (event_type = 'purchase')::INT AS y FROM events), a AS (SELECT k, score, y FROM e UNION ALL SELECT -1, score, y FROM e)"


def scored_events(spark, sf):
    """Every event under its user and under −1 for the whole table."""
    return table(spark, sf, "events").select(
        F.explode(F.array(F.col("user_id"), LIT(-1).cast("long"))).alias("k"), F.col("value").alias("score"),
        (F.col("event_type") == "purchase").cast("int").alias("y"))


@query("m3_eer", "M3", f"""WITH {EV}, r AS {roc_sql('a', 'k')},
b AS (SELECT k, p, n, score, abs(fp / n - (1 - tp / p)) AS d, (fp / n + 1 - tp / p) / 2 AS e FROM r WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg)
SELECT k, round(CASE WHEN max(p) > 0 AND max(n) > 0 THEN CASE WHEN min(d) < 1 THEN arg_min(e, (d, -score)) ELSE 0.5 END END, 6) AS eer FROM b GROUP BY k""")
def m3(spark, sf):
    return M.eer(scored_events(spark, sf), ["k"], "score", "y").select("k", r6("eer"))


@query("m4_best_threshold", "M4", f"""WITH {EV}, r AS {roc_sql('a', 'k')}, f AS (SELECT k, score, 2 * tp / greatest(1, tp + p + fp) AS f1 FROM r)
SELECT k, arg_max(score, (f1, score)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY k""")
def m4(spark, sf):
    return M.best_threshold(scored_events(spark, sf), ["k"], "score", "y").select("k", "threshold", r6("f1"))


@query("m5_at_threshold", "M5", f"""WITH {EV}, t AS (SELECT k, avg(score) AS th FROM a GROUP BY k),
c AS (SELECT k, count(*) FILTER (score >= th AND y = 1) AS tp, count(*) FILTER (score >= th AND y = 0) AS fp, count(*) FILTER (score < th AND y = 1) AS fn,
  count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1) AS pos FROM a JOIN t USING (k) GROUP BY k)
SELECT k, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1, round(fp / greatest(1, neg), 6) AS far, round(tp / greatest(1, pos), 6) AS recall FROM c""")
def m5(spark, sf):
    """The threshold is a mean of decimals: one of doubles depends on the order of the rows, and a score may equal it."""
    a = scored_events(spark, sf)
    th = a.groupBy("k").agg(F.avg(F.col("score").cast("decimal(28,10)")).cast("double").alias("th"))
    rows = a.join(th, "k")
    return M.at_threshold(rows, ["k"], "score", "y", "th").select("k", r6("f1"), r6("far"), r6("recall"))


@query("m6_average_precision", "M6", f"""WITH {EV}, r AS {roc_sql('a', 'k')}
SELECT k, round(CASE WHEN max(p) > 0 THEN sum(pos / p * tp / (tp + fp)) END, 6) AS ap FROM r GROUP BY k""")
def m6(spark, sf):
    return M.average_precision(scored_events(spark, sf), ["k"], "score", "y").select("k", r6("ap"))


POINTS = """pts AS (SELECT * FROM (VALUES ('fpr_0.01', 0.99::DOUBLE), ('fpr_0.05', 0.95::DOUBLE)) p(point, q))"""


@query("m7_operating_points", "M7", f"""WITH {SAMPLES}, {TASKED}, {POINTS},
c AS (SELECT task, point, quantile_cont(score, 0.99) FILTER (point = 'fpr_0.01') AS a, quantile_cont(score, 0.95) FILTER (point = 'fpr_0.05') AS b FROM tasked, pts WHERE split = 'validation' AND y = 0 GROUP BY 1, 2),
r AS (SELECT task, point, coalesce(a, b) AS threshold, avg((score > coalesce(a, b))::INT) FILTER (y = 1) AS tpr, avg((score > coalesce(a, b))::INT) FILTER (y = 0) AS fpr FROM tasked JOIN c USING (task) WHERE split = 'test' GROUP BY 1, 2, 3)
SELECT task, point, round(threshold, 4) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, rate, round(tpr * rate / greatest(1e-12, tpr * rate + fpr * (1 - rate)), 6) AS precision
FROM r, (VALUES (0.5::DOUBLE), (0.1::DOUBLE), (0.01::DOUBLE)) b(rate)""")
def m7(spark, sf):
    t = tasked(spark, sf)
    out = M.operating_points(t.where("split = 'validation'"), t.where("split = 'test'"), ["task"], "score", "y")
    return out.select("task", "point", F.round("threshold", 4).alias("threshold"), r6("tpr"), r6("fpr"), "rate", r6("precision"))


@query("m8_fpr_by_cell", "M8", f"""WITH {SAMPLES}, {TASKED}, t AS (SELECT task, quantile_cont(score, 0.5) AS th FROM tasked GROUP BY 1)
SELECT task, cell, round(avg((score >= th)::INT), 6) AS fpr FROM tasked JOIN t USING (task) WHERE y = 0 AND cell IN ('en', 'de') GROUP BY 1, 2""")
def m8(spark, sf):
    t = tasked(spark, sf)
    th = G.exact_quantiles(t, ["task"], "score", {"th": 0.5}).drop("n")
    rows = t.where((F.col("y") == 0) & F.col("cell").isin("en", "de")).join(th, "task")
    hit = (F.col("score") >= F.col("th")).cast("double")
    return rows.groupBy("task", "cell").agg(F.round(F.avg(hit), 6).alias("fpr"))


@query("m9_breakdown", "M9", f"""WITH {SAMPLES}, {TASKED}, g AS (SELECT task, grp, score FROM (SELECT task, score, unnest(['cell/' || cell, 'speaker/' || speaker_id, 'seen/' || (speaker_id < 'src3')::VARCHAR]) AS grp FROM tasked WHERE y = 1)),
n AS (SELECT task, score FROM tasked WHERE y = 0), all_ AS (SELECT task, grp, score, 1 AS y FROM g UNION ALL SELECT d.task, d.grp, n.score, 0 FROM (SELECT DISTINCT task, grp FROM g) d JOIN n ON n.task = d.task),
c AS (SELECT task, grp, count(*) AS k FROM g GROUP BY 1, 2)
SELECT a.task, a.grp AS "group", k AS n, round(auc, 6) AS auc FROM {auc_sql('all_', 'task, grp')} a JOIN c USING (task, grp)""")
def m9(spark, sf):
    groups = F.array(F.concat(LIT("cell/"), "cell"), F.concat(LIT("speaker/"), "speaker_id"),
                     F.concat(LIT("seen/"), (F.col("speaker_id") < "src3").cast("string")))
    out = M.versus_reals(tasked(spark, sf), ["task"], "score", F.col("y") == 1, F.col("y") == 0, groups)
    return out.select("task", "group", "n", r6("auc"))


GENDERED = """gendered AS (SELECT task, score, y, 'gender/' || CASE WHEN sample_id % 11 = 0 THEN NULL WHEN sample_id % 2 = 0 THEN 'F' ELSE 'M' END AS grp FROM tasked)"""


@query("m9_within_gender", "M9", f"""WITH {SAMPLES}, {TASKED}, {GENDERED}, g AS (SELECT * FROM gendered WHERE grp IS NOT NULL)
SELECT task, grp AS "group", k AS n, round(auc, 6) AS auc FROM (SELECT task, grp, count(*) FILTER (y = 1) AS k FROM g GROUP BY 1, 2) LEFT JOIN {auc_sql('g', 'task, grp')} a USING (task, grp)""")
def m9_gender(spark, sf):
    gender = F.when(F.col("sample_id") % 11 != 0, F.when(F.col("sample_id") % 2 == 0, "F").otherwise("M"))
    out = M.within_groups(tasked(spark, sf).withColumn("gender", gender), ["task"], "gender", "gender/", "score", "y")
    return out.select("task", "group", "n", r6("auc"))


@query("m10_per_speaker", "M10", f"""WITH {SAMPLES}, {TASKED}
SELECT task, count(*) AS speakers, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS min_auc FROM {auc_sql('tasked', 'task, speaker_id')} WHERE auc IS NOT NULL GROUP BY 1""")
def m10(spark, sf):
    return M.per_speaker(tasked(spark, sf), ["task"], "speaker_id", "score", "y").select("task", "speakers", r6("mean_auc"), r6("min_auc"))


@query("m11_reference_norm", "M11", f"""WITH {SAMPLES}, s AS (SELECT *, sample_id // 2 AS src FROM samples),
ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY sample_id) AS r FROM s WHERE y = 0) WHERE r <= 3),
st AS (SELECT speaker_id, avg(score) AS m, stddev_pop(score) + 1e-3 AS sd FROM ref GROUP BY 1),
k AS (SELECT 0 AS z, s.*, (score - m) / sd AS nz FROM s JOIN st USING (speaker_id) WHERE src NOT IN (SELECT src FROM ref))
SELECT a.n, round(a.auc, 6) AS auc_raw, round(b.auc, 6) AS auc_norm FROM {auc_sql('k', 'z')} a, {auc_sql('k', 'z', 'nz')} b""")
def m11(spark, sf):
    s = samples(spark, sf).withColumn("src", F.floor(F.col("sample_id") / 2))
    out = M.reference_norm(s, ["speaker_id"], "sample_id", "src", "score", "y", F.col("y") == 0, 3)
    return out.select("n", r6("auc_raw"), r6("auc_norm"))


@query("m12_confusion", "M12", f"""WITH {VECTORS}, g AS (SELECT label AS truth, list_position(v[1:10], list_max(v[1:10])) - 1 AS guess FROM vectors),
c AS (SELECT truth, guess, count(*) AS n FROM g GROUP BY 1, 2)
SELECT truth, guess::BIGINT AS guess, n, round(sum(CASE WHEN truth = guess THEN n ELSE 0 END) OVER (PARTITION BY truth) / sum(n) OVER (PARTITION BY truth), 6) AS recall,
  round(sum(CASE WHEN truth = guess THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS accuracy FROM c""")
def m12(spark, sf):
    heads = F.slice("v", 1, 10)
    g = vectors(spark, sf).select(F.col("label").alias("truth"), (F.array_position(heads, F.array_max(heads)) - 1).alias("guess"))
    return M.confusion(g, "truth", "guess").select("truth", "guess", "n", r6("recall"), r6("accuracy"))


TRUTH = """(t >= 10 + clip_id % 20 AND t < 22 + clip_id % 20)::INT"""


def truth_col():
    return ((F.col("t") >= 10 + F.col("clip_id") % 20) & (F.col("t") < 22 + F.col("clip_id") % 20)).cast("int")


@query("m13_localization", "M13", f"""WITH {SERIES}, s AS (SELECT clip_id, t, x, {TRUTH} AS y FROM series), e AS (SELECT clip_id, min(t) FILTER (y = 1) AS lo, max(t) FILTER (y = 1) AS hi, arg_max(y, (x, -t)) AS top FROM s GROUP BY 1),
m AS (SELECT clip_id, avg(x) FILTER (abs(t - lo) <= 2 OR abs(t - hi) <= 2) AS edge, avg(x) FILTER (NOT (abs(t - lo) <= 2 OR abs(t - hi) <= 2)) AS middle FROM s JOIN e USING (clip_id) WHERE y = 1 GROUP BY 1)
SELECT clip_id % 5 AS cell, count(*) AS clips, round(avg(auc), 6) AS auc, round(avg(top), 6) AS top_inside, round(avg(edge), 6) AS edge, round(avg(middle), 6) AS middle
FROM {auc_sql('s', 'clip_id', 'x')} JOIN e USING (clip_id) JOIN m USING (clip_id) WHERE auc IS NOT NULL GROUP BY 1""")
def m13(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", "x", truth_col().alias("y"))
    per = M.frame_localization(s, ["clip_id"], "t", "x", "y", hot_rows=hot)
    return per.groupBy((F.col("clip_id") % 5).alias("cell")).agg(
        F.count(LIT(1)).alias("clips"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("top_inside"), 6).alias("top_inside"),
        F.round(F.avg("edge"), 6).alias("edge"), F.round(F.avg("middle"), 6).alias("middle"))


@query("m14_temporal_ap", "M14")
def m14(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", (F.col("x") + 8 * truth_col()).alias("x"))
    found = G.proposals(s, ["clip_id"], "t", "x", hot_rows=hot)
    truth = s.select("clip_id").distinct().select(
        "clip_id", ((10 + F.col("clip_id") % 20) * 0.04).alias("a"), ((22 + F.col("clip_id") % 20) * 0.04).alias("b"))
    return M.temporal_scores(M.match_segments(found, truth, "clip_id"), "clip_id", hot)


@query("m15_shift_robustness", "M15", f"""WITH {SERIES}, c AS (SELECT clip_id, avg(x) AS s FROM series GROUP BY 1), th AS (SELECT quantile_cont(s, 0.95) AS th FROM c WHERE clip_id % 2 = 0),
k AS (SELECT unnest([0, 2, 3, 4]) AS k), sh AS (SELECT a.clip_id, k, avg(abs(a.x - coalesce(b.x, 0))) + avg(a.x) AS s FROM series a JOIN k ON true LEFT JOIN series b ON b.clip_id = a.clip_id AND b.t = a.t - k GROUP BY 1, 2),
t AS (SELECT * FROM sh WHERE clip_id % 2 = 1), u AS (SELECT a.k, a.s, 1 AS y FROM t a WHERE k > 0 UNION ALL SELECT k.k, t.s, 0 FROM t, k WHERE t.k = 0 AND k.k > 0)
SELECT f.k::BIGINT AS k, round(f.fpr, 6) AS fpr, round(auc, 6) AS auc FROM (SELECT k, avg((s > th)::INT) AS fpr FROM t, th GROUP BY k) f JOIN {auc_sql('u', 'k', 's')} a ON a.k = f.k""")
def m15(spark, sf):
    """Real clips with odd ids are tested, even ids set the threshold; the score reacts to a shift."""
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", "x")
    clean = s.groupBy("clip_id").agg(F.avg("x").alias("s"))
    cut = G.exact_quantiles(clean.where("clip_id % 2 = 0").withColumn("_all", LIT(0)), ["_all"], "s", {"th": 0.95}, hot)
    th = cut.select("th").scalar()
    shifted = []
    for k in (0, 2, 3, 4):
        moved = G.shift(s, ["clip_id"], "t", "x", k) if k else s.withColumn("shifted", F.col("x"))
        shifted.append(moved.groupBy("clip_id").agg((F.avg(F.abs(F.col("x") - F.col("shifted"))) + F.avg("x")).alias("s"))
                       .withColumn("k", LIT(k).cast("long")))
    test = shifted[0]
    for more in shifted[1:]:
        test = test.unionByName(more)
    test = test.where("clip_id % 2 = 1")
    base = test.where("k = 0").select("s", F.explode(F.array(*[LIT(k).cast("long") for k in (2, 3, 4)])).alias("k"), LIT(0).alias("y"))
    pairs = test.where("k > 0").select("s", "k", LIT(1).alias("y")).unionByName(base)
    fpr = test.groupBy("k").agg(F.round(F.avg((F.col("s") > th).cast("double")), 6).alias("fpr"))
    return fpr.join(M.auc(pairs, ["k"], "s", "y", hot_rows=hot).drop("n"), "k").select("k", "fpr", r6("auc"))


FAMILY = """['resize', 'crop', 'gain'][(('0x' || substr(sha1('pr:' || sample_id::VARCHAR), 1, 2))::BIGINT % 3 + 1)::INT]"""


@query("m16_pipeline_metrics", "M16", f"""WITH {SAMPLES}, p AS (SELECT 0 AS z, *, score + {hash_sql('sample_id')} % 200 AS pr, {FAMILY} AS family FROM samples),
th AS (SELECT quantile_cont(score, 0.95) AS th FROM p WHERE split = 'validation' AND y = 0), neg AS (SELECT * FROM p WHERE split = 'test' AND y = 0),
m AS (SELECT z, score AS s, 1 AS y FROM p WHERE split = 'test' AND y = 1 UNION ALL SELECT z, pr, 0 FROM neg), c AS (SELECT z, score AS s, 1 AS y FROM p WHERE split = 'test' AND y = 1 UNION ALL SELECT z, score, 0 FROM neg),
f AS (SELECT family, pr, score, th FROM neg, th)
SELECT 'auc_pipeline_matched' AS metric, round(auc, 6) AS value FROM {auc_sql('m', 'z', 's')} UNION ALL SELECT 'auc_clean_negatives', round(auc, 6) FROM {auc_sql('c', 'z', 's')}
UNION ALL SELECT 'fpr_processed', round(avg((pr > th)::INT), 6) FROM f UNION ALL SELECT 'fpr_clean', round(avg((score > th)::INT), 6) FROM f
UNION ALL SELECT 'fpr_' || family, round(avg((pr > th)::INT), 6) FROM f GROUP BY family
UNION ALL SELECT CASE WHEN family = 'gain' THEN 'fpr_unseen_family' ELSE 'fpr_seen_family' END, round(avg((pr > th)::INT), 6) FROM f GROUP BY 1""")
def m16(spark, sf):
    fam = F.element_at(F.array(LIT("resize"), LIT("crop"), LIT("gain")),
                       (sha1_byte(F.concat(LIT("pr:"), F.col("sample_id")), 0) % 3 + 1).cast("int"))
    p = samples(spark, sf).select("split", "y", "score", (F.col("score") + stable_int(F.col("sample_id")) % 200).alias("pr"),
                                  fam.alias("family"), LIT(0).alias("z"))
    th = G.exact_quantiles(p.where("split = 'validation' AND y = 0"), ["z"], "score", {"th": 0.95}).select("th").scalar()
    test = p.where("split = 'test'")
    matched = test.withColumn("s", F.when(F.col("y") == 0, F.col("pr")).otherwise(F.col("score")))
    neg = test.where("y = 0")
    hit = (F.col("pr") > th).cast("double")

    def named(df, name, value):
        return df.select(name.alias("metric"), F.round(value, 6).alias("value"))

    a = named(M.auc(matched, ["z"], "s", "y"), LIT("auc_pipeline_matched"), F.col("auc"))
    b = named(M.auc(test, ["z"], "score", "y"), LIT("auc_clean_negatives"), F.col("auc"))
    total = neg.agg(F.avg(hit).alias("p"), F.avg((F.col("score") > th).cast("double")).alias("c"))
    by = neg.groupBy("family").agg(F.avg(hit).alias("v"))
    seen = F.when(F.col("family") == "gain", LIT("fpr_unseen_family")).otherwise(LIT("fpr_seen_family"))
    groups = neg.groupBy(seen.alias("g")).agg(F.avg(hit).alias("v"))
    return (a.unionByName(b).unionByName(named(total, LIT("fpr_processed"), F.col("p"))).unionByName(named(total, LIT("fpr_clean"), F.col("c")))
            .unionByName(named(by, F.concat(LIT("fpr_"), "family"), F.col("v"))).unionByName(named(groups, F.col("g"), F.col("v"))))


VARIANTS = f"""variants AS (SELECT s.*, v.variant, score * f + {hash_sql('sample_id')} % 50 AS vs FROM samples s, (VALUES ('c360', 0.8::DOUBLE), ('c480', 0.9::DOUBLE)) v(variant, f))"""


def variants(spark, sf):
    v = F.explode(F.array(F.struct(LIT("c360").alias("variant"), LIT(0.8).alias("f")), F.struct(LIT("c480").alias("variant"), LIT(0.9).alias("f")))).alias("v")
    s = samples(spark, sf).select("*", v).select("*", "v.variant", "v.f").drop("v")
    return s.withColumn("vs", F.col("score") * F.col("f") + stable_int(F.col("sample_id")) % 50).drop("f")


@query("m17_variant_metrics", "M17", f"""WITH {SAMPLES}, {VARIANTS}, clean AS (SELECT quantile_cont(score, 0.95) AS th FROM samples WHERE split = 'validation' AND y = 0),
same AS (SELECT variant, quantile_cont(vs, 0.95) AS th FROM variants WHERE split = 'validation' AND y = 0 GROUP BY 1), t AS (SELECT * FROM variants WHERE split = 'test')
SELECT a.variant, round(a.auc, 6) AS auc, round(r.fc, 6) AS fpr_clean_threshold, round(r.tc, 6) AS tpr_clean_threshold, round(r.fs, 6) AS fpr_same_quality, round(r.ts, 6) AS tpr_same_quality FROM {auc_sql('t', 'variant', 'vs')} a JOIN (
  SELECT variant, avg((vs > clean.th)::INT) FILTER (y = 0) AS fc, avg((vs > clean.th)::INT) FILTER (y = 1) AS tc, avg((vs > same.th)::INT) FILTER (y = 0) AS fs, avg((vs > same.th)::INT) FILTER (y = 1) AS ts
  FROM t JOIN same USING (variant), clean GROUP BY 1) r USING (variant)""")
def m17(spark, sf):
    v = variants(spark, sf)
    clean = G.exact_quantiles(samples(spark, sf).where("split = 'validation' AND y = 0").withColumn("z", LIT(0)), ["z"], "score", {"th": 0.95})
    same = G.exact_quantiles(v.where("split = 'validation' AND y = 0"), ["variant"], "vs", {"same": 0.95}).drop("n")
    test = v.where("split = 'test'")
    th = clean.select("th").scalar()
    y, vs = F.col("y"), F.col("vs")

    def rate(cut, label):
        return F.round(F.avg(F.when(y == label, (vs > cut).cast("double"))), 6)

    rates = test.join(same, "variant").groupBy("variant").agg(
        rate(th, 0).alias("fpr_clean_threshold"), rate(th, 1).alias("tpr_clean_threshold"),
        rate(F.col("same"), 0).alias("fpr_same_quality"), rate(F.col("same"), 1).alias("tpr_same_quality"))
    return M.auc(test, ["variant"], "vs", "y").select("variant", r6("auc")).join(rates, "variant")


@query("m18_zscore_fusion", "M18", f"""WITH {SAMPLES}, s AS (SELECT *, ({hash_sql('sample_id')} % 1000)::DOUBLE AS b FROM samples), st AS (SELECT avg(score) AS ma, stddev_pop(score) + 1e-6 AS sa, avg(b) AS mb, stddev_pop(b) + 1e-6 AS sb FROM s WHERE split = 'validation' AND y = 0)
SELECT sample_id, round((score - ma) / sa, 6) AS z_visual, round((b - mb) / sb, 6) AS z_audio, round(greatest((score - ma) / sa, (b - mb) / sb), 6) AS z_ai FROM s, st WHERE split = 'test'""")
def m18(spark, sf):
    s = samples(spark, sf).withColumn("b", (stable_int(F.col("sample_id")) % 1000).cast("double"))
    out = M.zscore_fusion(s.where("split = 'validation'"), s.where("split = 'test'"), F.col("y") == 0, "sample_id", {"visual": "score", "audio": "b"})
    return out.select("sample_id", r6("z_visual"), r6("z_audio"), r6("z_ai"))


def two_models(spark, sf):
    s = samples(spark, sf)
    return s.withColumn("b", (stable_int(F.col("sample_id")) % 5000).cast("double") + F.col("score") / 4)


@query("m19_paired_bootstrap", "M19")
def m19(spark, sf):
    return M.paired_bootstrap(two_models(spark, sf), "speaker_id", "y", "score", "b")


@query("m19_paired_delta_point", "M19", f"""WITH {SAMPLES}, s AS (SELECT 0 AS z, *, ({hash_sql('sample_id')} % 5000)::DOUBLE + score / 4 AS b FROM samples)
SELECT round(a.auc - b.auc, 6) AS delta, (SELECT count(DISTINCT speaker_id) FROM s) AS speakers, (SELECT count(*) FROM s) AS samples FROM {auc_sql('s', 'z')} a, {auc_sql('s', 'z', 'b')} b""")
def m19_point(spark, sf):
    out = M.paired_bootstrap(two_models(spark, sf), "speaker_id", "y", "score", "b", replicates=20)
    return out.select(r6("delta"), "speakers", "samples")


# Fixed values: (gate, task label, subset); every gate compares the first model with the second.
GATES = [("G1 all samples", "y", None), ("G2 unseen sources", "y", "unseen"), ("G3 one cell", "y", "cell:en"), ("G4 second task", "y2", None)]


@query("m20_gates", "M20")
def m20(spark, sf):
    s = two_models(spark, sf)
    seen = s.where("split = 'train' AND sample_id % 3 = 0")
    out = None
    for name, label, subset in GATES:
        rows = s
        if subset == "unseen":
            rows = gate_subset(s, label, "speaker_id", seen=seen)
        elif subset:
            rows = gate_subset(s, label, "speaker_id", cell=("cell", subset.split(":")[1]))
        one = M.paired_bootstrap(rows, "speaker_id", label, "score", "b", replicates=200).withColumn("gate", LIT(name))
        out = one if out is None else out.unionByName(one)
    return out


# Fixed values: (first, second, task, note, subset, variant). Model m4 has no runs, m3 none on the compressed set.
GATE_ROWS = [("m1", "m2", "y", "R1 all", None, None), ("m1", "m2", "y", "R2 compressed", None, "c480"), ("m1", "m3", "y", "R3 against m3", None, None), ("m1", "m3", "y", "R4 m3 compressed", None, "c480"),
             ("m1", "m4", "y", "R5 without a run", None, None), ("m1", "m2", "y2", "R6 second task, one cell", "cell:en", None), ("m1", "m2", "y", "R7 unseen sources", "unseen", "c480")]
RUNS = [("m1", 42, None), ("m1", 43, None), ("m1", 42, "c480"), ("m2", 42, None), ("m2", 42, "c480"), ("m3", 7, None)]


def gate_scores(spark, sf):
    """Runs of three models: scores from the text length and a hash of model, variant and sample; seed 43 is another run."""
    s, out = samples(spark, sf), None
    for model, seed, variant in RUNS:
        noise = stable_int(F.concat(LIT(f"{model}{seed}{variant or ''}:"), "sample_id")) % 5000
        one = s.select(LIT(model).alias("model"), LIT(seed).alias("seed"), LIT(variant).cast("string").alias("variant"), "sample_id", (noise.cast("double") + F.col("score") / 4).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("task", F.explode(F.array(LIT("y"), LIT("y2"))))


def gates_sql() -> str:
    """Point values of the gates that can be judged; the smallest seeds are m1 42, m2 42, m3 7."""
    parts, have = [], {(m, v) for m, _, v in RUNS}
    seeds = {"m1": 42, "m2": 42, "m3": 7}
    noise = lambda m, v: hash_sql(f"'{m}{seeds[m]}{v or ''}:' || sample_id::VARCHAR") + " % 5000 + score / 4"
    for k, (a, b, task, note, subset, variant) in enumerate(GATE_ROWS):
        if (a, variant) not in have or (b, variant) not in have:
            continue
        where = {"cell:en": f"{task} = 0 OR cell = 'en'", "unseen": f"{task} = 0 OR speaker_id NOT IN (SELECT speaker_id FROM samples WHERE split = 'train' AND sample_id % 3 = 0 AND speaker_id < 'src3')"}.get(subset, "true")
        parts.append(f"""SELECT '{a}' AS first, '{b}' AS second, '{task}' AS task, '{note}' AS note, {f"'{subset}'" if subset else 'NULL'} AS subset, {f"'{variant}'" if variant else 'NULL'} AS variant,
  round(p.auc - q.auc, 6) AS delta, (SELECT count(DISTINCT speaker_id) FROM t{k}) AS speakers, (SELECT count(*) FROM t{k}) AS samples FROM {auc_sql(f't{k}', 'z', 'sa', task)} p, {auc_sql(f't{k}', 'z', 'sb', task)} q""")
        parts[-1] = (f"t{k} AS (SELECT 0 AS z, *, ({noise(a, variant)})::DOUBLE AS sa, ({noise(b, variant)})::DOUBLE AS sb FROM samples WHERE {where})", parts[-1])
    return f"WITH {SAMPLES}, " + ", ".join(p[0] for p in parts) + " " + " UNION ALL ".join(p[1] for p in parts)


def gate_rows(spark, sf, replicates):
    s = samples(spark, sf)
    seen = s.where("split = 'train' AND sample_id % 3 = 0 AND speaker_id < 'src3'")

    def subset(rows, task, name):
        if name.startswith("cell:"):
            return gate_subset(rows, task, "speaker_id", cell=("cell", name.split(":")[1]))
        return gate_subset(rows, task, "speaker_id", seen=seen)

    return M.gate_table(gate_scores(spark, sf), s.drop("score"), "speaker_id", GATE_ROWS, subset, replicates)


@query("m20_gate_rows", "M20", gates_sql())
def m20_rows(spark, sf):
    """Gates over models, tasks, subsets and variants; those of missing runs are left out."""
    return gate_rows(spark, sf, 20).select("first", "second", "task", "note", "subset", "variant", r6("delta"), "speakers", "samples")


@query("m21_over_seeds", "M21", """
WITH s AS (SELECT event_type AS model, user_id % 3 AS seed, avg(sqrt(value)) AS v FROM events WHERE event_type <> 'view' OR user_id % 3 = 0 GROUP BY 1, 2)
SELECT model, count(v) AS k, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM s GROUP BY 1""")
def m21(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'view' OR user_id % 3 = 0")
    s = e.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("seed")).agg(F.avg(F.sqrt("value")).alias("v"))
    return M.over_seeds(s, ["model"], "v").select("model", "k", r6("mean"), r6("std"))


@query("m22_roc_points", "M22", f"""WITH {EV}, r AS {roc_sql('a', 'k')}, m AS (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM r)
SELECT k, score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM m WHERE (i - 1) % greatest(1, m // 20) = 0""")
def m22(spark, sf):
    return M.roc_points(scored_events(spark, sf), ["k"], "score", "y", 20).select("k", "score", r6("fpr"), r6("tpr"))


@query("m22_score_histogram", "M22", f"""WITH {SAMPLES}
SELECT cell, CASE WHEN score < 0 THEN 0 WHEN score >= 5000 THEN 11 ELSE floor(score / 500) + 1 END::BIGINT AS bin, count(*) AS n FROM samples GROUP BY 1, 2""")
def m22_hist(spark, sf):
    return M.histogram(samples(spark, sf), ["cell"], "score", 0.0, 5000.0, 10)


AUDIT = f"""aud AS (SELECT s.*, f.feature, CASE f.feature WHEN 'chars' THEN score WHEN 'lines' THEN len(string_split(text, chr(10)))::DOUBLE ELSE (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS v
  FROM samples s JOIN documents d ON d.doc_id = s.sample_id, (VALUES ('chars'), ('lines'), ('spaces')) f(feature)),
au AS (SELECT 'overall' AS grp, feature, auc FROM {auc_sql('aud', 'feature', 'v')} UNION ALL SELECT 'cell/' || cell, feature, auc FROM {auc_sql('''(SELECT feature, c.cell, v, 1 AS y FROM aud JOIN (SELECT DISTINCT cell FROM aud) c USING (cell) WHERE y = 1
   UNION ALL SELECT feature, c.cell, v, 0 FROM aud, (SELECT DISTINCT cell FROM aud WHERE y = 1) c WHERE y = 0)''', 'feature, cell', 'v')})"""


@query("m23_shortcut_audit", "M23", f"""WITH {SAMPLES}, {AUDIT} SELECT grp AS "group", feature, round(auc, 6) AS auc, abs(auc - 0.5) > 0.2 AS flag FROM au""")
def m23(spark, sf):
    text = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
        (F.length("text") - F.length(F.replace("text", LIT(" "), LIT("")))).cast("double").alias("spaces"))
    s = samples(spark, sf).join(text, "sample_id").withColumn("chars", F.col("score"))
    long = s.unpivot(["sample_id", "cell", "y"], ["chars", "lines", "spaces"], "feature", "v")
    groups = F.array(LIT("overall"), F.concat(LIT("cell/"), "cell"))
    out = M.versus_reals(long, ["feature"], "v", F.col("y") == 1, F.col("y") == 0, groups)
    return out.select("group", "feature", r6("auc"), (F.abs(F.col("auc") - 0.5) > 0.2).alias("flag"))


@query("m24_coupling_audit", "M24", f"""WITH {COUPLING}, l AS (SELECT -round(coupling, 9) AS s, CASE clip_id % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'sham' WHEN 2 THEN 'donor' ELSE 'both' END AS cell FROM coupled WHERE coupling IS NOT NULL),
u AS (SELECT cell, s, 1 AS y FROM l WHERE cell <> 'real' UNION ALL SELECT c.cell, s, 0 FROM l, (VALUES ('sham'), ('donor'), ('both')) c(cell) WHERE l.cell = 'real'), k AS (SELECT cell, count(*) AS n FROM l GROUP BY 1)
SELECT cell, k.n, round(auc, 6) AS auc FROM {auc_sql('u', 'cell', 's')} a JOIN k USING (cell)""")
def m24(spark, sf):
    c = G.coupling(two_series(spark, sf), ["clip_id"], "t", "x", "y", "valid").where("coupling IS NOT NULL")
    cell = F.element_at(F.array(*[LIT(x) for x in ("real", "sham", "donor", "both")]), (F.col("clip_id") % 4 + 1).cast("int"))
    rows = c.select((-F.round("coupling", 9)).alias("s"), cell.alias("cell"), LIT(0).alias("z"))
    real = F.col("cell") == "real"
    out = M.versus_reals(rows, ["z"], "s", ~real, real, F.array("cell"))
    return out.select(F.col("group").alias("cell"), "n", r6("auc"))


@query("m26_validation_metrics", "M26", f"""WITH {SAMPLES}, {VARIANTS}, v AS (SELECT 'clean' AS variant, score AS s, y, split FROM samples UNION ALL SELECT variant, vs, y, split FROM variants), x AS (SELECT * FROM v WHERE split = 'validation'),
a AS (SELECT variant, auc FROM {auc_sql('x', 'variant', 's')})
SELECT 'val_auc_' || variant AS metric, round(auc, 6) AS value FROM a UNION ALL SELECT 'val_auc', CASE WHEN count(*) = count(auc) THEN round(avg(auc), 6) END FROM a""")
def m26(spark, sf):
    clean = samples(spark, sf).select(LIT("clean").alias("variant"), F.col("score").alias("s"), "y", "split")
    v = clean.unionByName(variants(spark, sf).select("variant", F.col("vs").alias("s"), "y", "split")).where("split = 'validation'")
    a = M.auc(v, ["variant"], "s", "y")
    mean = a.agg(F.when(F.count(LIT(1)) == F.count("auc"), F.round(F.avg("auc"), 6)).alias("value"))
    return a.select(F.concat(LIT("val_auc_"), "variant").alias("metric"), F.round("auc", 6).alias("value")).unionByName(
        mean.select(LIT("val_auc").alias("metric"), "value"))


@query("m27_jump_evaluation", "M27", """
WITH e AS (SELECT *, event_id % 2 = 1 AS positive, floor(value / 50) AS bucket, event_type IN ('error', 'view') AS confident, event_type = 'click' AS suspect FROM events)
SELECT CASE WHEN positive THEN 'gap ' || least(bucket, 3)::BIGINT::VARCHAR ELSE 'negative' END AS bucket, count(*) AS n, sum(confident::INT)::BIGINT AS confident, sum((confident OR suspect)::INT)::BIGINT AS any_level,
  round(avg(confident::INT), 6) AS confident_rate FROM e GROUP BY 1""")
def m27(spark, sf):
    kind = F.col("event_type")
    confident = kind.isin("error", "view").cast("long")
    bucket = F.least(F.floor(F.col("value") / 50), LIT(3)).cast("string")
    name = F.when(F.col("event_id") % 2 == 1, F.concat(LIT("gap "), bucket)).otherwise(LIT("negative"))
    return table(spark, sf, "events").groupBy(name.alias("bucket")).agg(
        F.count(LIT(1)).alias("n"), F.sum(confident).alias("confident"),
        F.sum(F.greatest(confident, (kind == "click").cast("long"))).alias("any_level"),
        F.round(F.avg(confident), 6).alias("confident_rate"))


@query("m28_report_table", "M28", f"""WITH {SAMPLES}, {TASKED}, m AS (SELECT task, 'n_chars' AS model, score, y FROM tasked UNION ALL SELECT task, 'hash', ({hash_sql('sample_id')} % 1000)::DOUBLE, y FROM tasked)
SELECT model, round(max(auc) FILTER (task = 'ai'), 6) AS ai, round(max(auc) FILTER (task = 'toxic'), 6) AS toxic FROM {auc_sql('m', 'model, task')} GROUP BY 1""")
def m28(spark, sf):
    t = tasked(spark, sf)
    other = t.withColumn("score", (stable_int(F.col("sample_id")) % 1000).cast("double"))
    both = t.withColumn("model", LIT("n_chars")).unionByName(other.withColumn("model", LIT("hash")))
    a = M.auc(both, ["model", "task"], "score", "y")
    return a.groupBy("model").pivot("task", ["ai", "toxic"]).agg(F.round(F.max("auc"), 6))


@query("m29_flatten_metrics", "M29", f"""WITH {SAMPLES}, {TASKED}, a AS (SELECT task, 'all' AS grp, n, auc FROM {auc_sql('tasked', 'task')} UNION ALL SELECT task, 'cell/' || cell, n, auc FROM {auc_sql('tasked', 'task, cell')})
SELECT task, grp AS "group", metric, round(CASE WHEN metric = 'n' THEN n ELSE auc END, 6) AS value FROM a, (VALUES ('n'), ('auc')) m(metric) WHERE metric = 'n' OR auc IS NOT NULL""")
def m29(spark, sf):
    """Nested metrics per task (map group → struct) flattened to one row per value."""
    t = tasked(spark, sf)
    groups = t.withColumn("group", F.explode(F.array(LIT("all"), F.concat(LIT("cell/"), "cell"))))
    a = M.auc(groups, ["task", "group"], "score", "y")
    nested = a.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("group", F.struct("n", "auc")))).alias("breakdown"))
    flat = nested.select("task", F.explode("breakdown").alias("group", "m")).select("task", "group", "m.n", "m.auc")
    long = flat.unpivot(["task", "group"], ["n", "auc"], "metric", "value").where("value IS NOT NULL")
    return long.select("task", "group", "metric", r6("value"))


@query("m30_sign_check", "M30", f"""WITH {VSER}, {HALVES}, l AS (SELECT unnest(range(-15, 16)) AS lag), d AS (SELECT h.clip_id, h.t, h.a, h.b, list_transform(range(0, 32), lambda z: 0.0::DOUBLE) AS zero FROM halves h),
sh AS (SELECT d.clip_id, d.t, d.a, coalesce(o.b, d.zero) AS b, d.zero FROM d LEFT JOIN d o ON o.clip_id = d.clip_id AND o.t = d.t - 3),
c0 AS (SELECT h.clip_id, lag, avg(list_distance(list_transform(coalesce(o.b, h.zero), lambda z: z + 1e-6), h.a)) AS d FROM d h JOIN l ON true LEFT JOIN d o ON o.clip_id = h.clip_id AND o.t = h.t + lag GROUP BY 1, 2),
c1 AS (SELECT h.clip_id, lag, avg(list_distance(list_transform(coalesce(o.b, h.zero), lambda z: z + 1e-6), h.a)) AS d FROM sh h JOIN l ON true LEFT JOIN sh o ON o.clip_id = h.clip_id AND o.t = h.t + lag GROUP BY 1, 2)
SELECT a.clip_id, a.lag AS lag_before, b.lag AS lag_after, abs(b.lag - a.lag - 3) <= 1 AS ok FROM (SELECT clip_id, arg_min(lag, (d, lag)) AS lag FROM c0 GROUP BY 1) a JOIN (SELECT clip_id, arg_min(lag, (d, lag)) AS lag FROM c1 GROUP BY 1) b USING (clip_id)""")
def m30(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    late = G.delay_vectors(s, ["clip_id"], "t", "b", 3, 32)

    def best(rows, name):
        lag, _ = G.curve_stats(F.col("curve"), lowest=True)
        return G.distance_curve(rows, ["clip_id"], "t", "a", "b", 32).select("clip_id", lag.alias(name))

    both = best(s, "lag_before").join(best(late, "lag_after"), "clip_id")
    return both.withColumn("ok", F.abs(F.col("lag_after") - F.col("lag_before") - 3) <= 1)


@query("b27_decision", "B27", f"""WITH {SAMPLES}, {TASKED}, op AS (SELECT task, quantile_cont(score, 0.95) AS t FROM tasked WHERE split = 'validation' AND y = 0 AND task = 'toxic' GROUP BY 1),
r AS {roc_sql("(SELECT * FROM tasked WHERE split = 'validation')", 'task')}, f AS (SELECT task, arg_max(score, (2 * tp / greatest(1, tp + p + fp), score)) AS t FROM r GROUP BY 1),
th AS (SELECT f.task, coalesce(op.t, f.t) AS t FROM f LEFT JOIN op USING (task))
SELECT sample_id, task, CASE WHEN cell = 'de' THEN NULL ELSE score >= CASE WHEN cell = 'fr' THEN (SELECT t FROM th WHERE task = 'toxic') ELSE th.t END END AS decision FROM tasked JOIN th USING (task) WHERE split = 'test'""")
def b27(spark, sf):
    """Only one task has an operating point; 'fr' rows count as gated, 'de' rows have no score."""
    t = tasked(spark, sf)
    val = t.where("split = 'validation'")
    op = M.alarm_thresholds(val.where("y = 0 AND task = 'toxic'"), ["task"], "score").where("point = 'fpr_0.05'")
    f1 = M.best_threshold(val, ["task"], "score", "y").select("task", F.col("threshold").alias("f1"))
    th = f1.join(op.select("task", "threshold"), "task", "left").select("task", F.coalesce("threshold", "f1").alias("t"))
    audio = th.where("task = 'toxic'").select("t").scalar()
    score = F.when(F.col("cell") != "de", F.col("score"))
    cut = F.when(F.col("cell") == "fr", audio).otherwise(F.col("t"))
    return t.where("split = 'test'").join(th, "task").select("sample_id", "task", (score >= cut).alias("decision"))
