"""Sequence signals."""

from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.functions.text import clean_words, edit_words
from framesift.operators import signals as G
from framesift.operators.donors import nearest_donor
from framesift.operators.joins import reference_of
from framesift.operators.ordered import HOT_ROWS, positions, settle
from framesift.plans.fixtures import (
    CLIPS, CROSSING, MEASURED, SERIES, VECTORS, clips, crossing_clips, event_limit, hash_sql, measured, series, vectors,
)
from framesift.plans.registry import query
from framesift.plans.spans import runs_sql
from framesift.session import table

LIT = F.lit


def frames(spark, sf):
    return series(spark, sf, event_limit(spark, sf))


def vector_series(spark, sf):
    """Embeddings of one label in id order: (clip_id, t, v)."""
    v = vectors(spark, sf)
    hot = settle(v, ["label"], HOT_ROWS)
    return positions(v, ["label"], ["vec_id"], hot_rows=hot).withColumnRenamed("label", "clip_id")


VSER = f"""{VECTORS}, vser AS (SELECT label AS clip_id, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM vectors)"""


@query("c18_random_span", "C18", f"""WITH {CLIPS}, f AS (SELECT clip_id, round_even(duration_s * 25, 0)::BIGINT AS f FROM clips),
l AS (SELECT *, least(75, f - 24) AS longest FROM f),
n AS (SELECT *, CASE WHEN longest >= 8 THEN 8 + {hash_sql("'42:' || clip_id::VARCHAR || ':length'")} % (longest - 8 + 1) END AS len FROM l),
s AS (SELECT *, 12 + {hash_sql("'42:' || clip_id::VARCHAR || ':start'")} % (f - 24 - len + 1) AS start FROM n)
SELECT clip_id, start, start + len AS stop, CASE WHEN len IS NULL THEN 'Clip too short for a partial segment' END AS reason FROM s""")
def c18(spark, sf):
    f = F.bround(F.col("duration_s") * 25, 0).cast("long")
    rows = clips(spark, sf).select("clip_id", f.alias("f"))
    a, b, reason = G.random_span(F.col("clip_id"), F.col("f"), 8, 75, 12, "42")
    return rows.select("clip_id", a.alias("start"), b.alias("stop"), reason.alias("reason"))


@query("c20_phrases", "C20", """
WITH w AS (SELECT conv_id, turn, len(l) * 0.4::DOUBLE AS d, unnest(range(0, len(l))) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations)),
p AS (SELECT a.conv_id, a.turn, a.i, b.i AS j, a.i * 0.4::DOUBLE AS s, b.i * 0.4::DOUBLE + 0.4::DOUBLE AS e, a.d FROM w a
  JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i >= a.i AND b.i <= a.i + 9)
SELECT conv_id, turn, count(*) AS n, sum(i)::BIGINT AS si, sum(j)::BIGINT AS sj FROM p
WHERE e - s <= 3.05 AND e - s >= 0.55 AND s >= 0.5 AND e <= d - 0.5 GROUP BY 1, 2""")
def c20(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("l"))
    n = F.size("l")
    words = rows.select("conv_id", "turn", (n * 0.4).alias("d"), F.explode(F.sequence(LIT(0), n - 1)).alias("i"))
    words = words.select("conv_id", "turn", "d", "i", (F.col("i") * 0.4).alias("start"), (F.col("i") * 0.4 + 0.4).alias("end"))
    out = G.phrases(words, ["conv_id", "turn"], F.col("d"), 0.55, 3.05, 0.5)
    return out.groupBy("conv_id", "turn").agg(F.count(LIT(1)).alias("n"), F.sum("i").alias("si"), F.sum("j").alias("sj"))


@query("c21_edit_words", "C21", f"""
WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: regexp_replace(lower(x), '[^\\wÀ-ỹ]', '', 'g')) AS l FROM conversations),
j AS (SELECT conv_id, turn, l, array_to_string(l, ' ') AS s, list_position(list_transform(l, lambda x: regexp_full_match(x, '[0-9]{{1,15}}') OR x IN ('one','two','three')), true) AS at_,
  {hash_sql("'7:' || conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h FROM w),
k AS (SELECT *, coalesce(abs(try_cast(l[at_] AS BIGINT) + [-3,-2,-1,1,2,3,5,10][(h % 8 + 1)::INT])::VARCHAR,
  ['one','two','three'][((list_position(['one','two','three'], l[at_]) - 1 + 1 + h % 2) % 3 + 1)::INT]) AS num FROM j)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '(^| )of the( |$)') THEN regexp_replace(s, '(^| )of the( |$)', '\\1against any\\2')
  WHEN regexp_matches(s, '(^| )the( |$)') THEN regexp_replace(s, '(^| )the( |$)', '\\1not the\\2')
  WHEN regexp_matches(s, '(^| )la( |$)') THEN regexp_replace(s, '(^| )la( |$)', '\\1sans la\\2')
  WHEN at_ > 0 THEN array_to_string(list_concat(list_concat(l[1:at_ - 1], [num]), l[at_ + 1:]), ' ') END AS text,
  CASE WHEN regexp_matches(s, '(^| )of the( |$)') THEN 'swap:of the->against any' WHEN regexp_matches(s, '(^| )the( |$)') THEN 'swap:the->not the'
  WHEN regexp_matches(s, '(^| )la( |$)') THEN 'swap:la->sans la' WHEN at_ > 0 THEN 'number' END AS kind FROM k""")
def c21(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", clean_words(F.col("text")).alias("w"))
    ident = F.concat_ws(":", "conv_id", "turn")
    swaps = {"of the": "against any", "the": "not the", "la": "sans la"}
    edit = edit_words(F.col("w"), ident, "7", swaps, ["one", "two", "three"])
    return rows.select("conv_id", "turn", edit.alias("e")).select("conv_id", "turn", "e.text", "e.kind")


PROFILE = """db AS (SELECT clip_id, t, value, 20 * log10(abs(value) + 1e-9) AS db FROM series),
top AS (SELECT clip_id, max(db) AS top, count(*) AS n FROM db GROUP BY 1)"""


@query("c22_edge_silence", "C22", f"""WITH {SERIES}, {PROFILE}
SELECT clip_id, max(n) AS n, min(t) FILTER (db > top - 12) AS first, max(t) FILTER (db > top - 12) AS last,
  round(1 - avg((db > top - 12)::INT), 6) AS silence, round(avg(db) FILTER (db > top - 12), 6) AS level FROM db JOIN top USING (clip_id) GROUP BY clip_id""")
def c22(spark, sf):
    return G.loud_profile(frames(spark, sf), ["clip_id"], "t", "value", 12.0).select(
        "clip_id", "n", "first", "last", F.round("silence", 6).alias("silence"), F.round("level", 6).alias("level"))


@query("c23_trim_silence", "C23", f"""WITH {SERIES}, {PROFILE},
e AS (SELECT clip_id, min(t) FILTER (db > top - 6) AS a, max(t) FILTER (db > top - 6) AS b FROM db JOIN top USING (clip_id) GROUP BY 1)
SELECT clip_id, t, value FROM series JOIN e USING (clip_id) WHERE t BETWEEN a AND b""")
def c23(spark, sf):
    return G.trim_silence(frames(spark, sf).select("clip_id", "t", "value"), ["clip_id"], "t", "value", 6.0)


@query("c24_noise_floor", "C24", f"""WITH {SERIES}, n AS (SELECT clip_id, count(*) AS n FROM series GROUP BY 1),
s AS (SELECT clip_id, n, unnest(range(0, n - 8, 4)) AS start FROM n WHERE n >= 16),
r AS (SELECT s.clip_id, s.start, sqrt(avg(x * x)) AS rms FROM s JOIN series f ON f.clip_id = s.clip_id AND t >= start AND t < start + 8 GROUP BY 1, 2)
SELECT clip_id, arg_min(start, (round(rms, 9), start)) AS start, round(min(rms), 6) AS rms FROM r GROUP BY clip_id""")
def c24(spark, sf):
    out = G.noise_floor(frames(spark, sf), ["clip_id"], "t", "x", 8)
    return out.select("clip_id", "start", F.round("rms", 6).alias("rms"))


@query("c25_speech_window", "C25", f"""WITH {SERIES}, {PROFILE}, lq AS (SELECT clip_id, t, db > top - 20 AS loud, n FROM db JOIN top USING (clip_id)),
q AS (SELECT r.*, n FROM {runs_sql('NOT loud', 'lq')} r JOIN top USING (clip_id)),
p AS (SELECT * FROM q WHERE stop - start >= 2 OR start = 0 OR stop = n),
o AS (SELECT clip_id, stop AS o FROM p WHERE stop < n UNION SELECT clip_id, 0 FROM lq WHERE t = 0 AND loud),
e AS (SELECT clip_id, start AS e FROM p WHERE start > 0),
c AS (SELECT clip_id, o, e, abs(e - o - (10 + clip_id % 7)) AS err FROM o JOIN e USING (clip_id) WHERE o < e AND e <= o + 25)
SELECT clip_id, arg_min(o, (err, -(e - o), o, e)) AS onset, arg_min(e, (err, -(e - o), o, e)) AS "offset", min(err)::DOUBLE AS error FROM c GROUP BY 1""")
def c25(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot)
    targets = s.select("clip_id").distinct().select(
        "clip_id", (10 + F.col("clip_id") % 7).cast("double").alias("target"), LIT(25).alias("room"))
    return G.speech_window(s, ["clip_id"], "t", "value", targets, 20.0, 2, hot)


@query("c26_best_donor", "C26", f"""WITH {CROSSING}, n AS (SELECT clip_id, any_value(duration_s) AS d,
  min({{'s': size, 'i': other}}) FILTER (size > duration_s OR (size = duration_s AND other > clip_id)) AS up, max({{'s': size, 'i': other}}) FILTER (size < duration_s OR (size = duration_s AND other < clip_id)) AS dn,
  max({{'s': size, 'i': other}}) AS top FROM apart GROUP BY 1),
e AS (SELECT *, up.s - d AS u, CASE WHEN dn.s >= d - 1.0 - 1e-6 THEN d - dn.s END AS l FROM n),
f AS (SELECT *, CASE WHEN u IS NOT NULL AND (l IS NULL OR u <= l) THEN up.i WHEN l IS NOT NULL THEN dn.i END AS fit FROM e)
SELECT clip_id, coalesce(fit, top.i) AS donor, CASE WHEN fit IS NOT NULL THEN round(least(u, l), 6) END AS error, fit IS NULL AS cut FROM crossing LEFT JOIN f USING (clip_id)""")
def c26(spark, sf):
    out = nearest_donor(crossing_clips(spark, sf), ["split", "speaker_id"], "clip_id", "duration_s", "source_id", "start_s", "end_s", 1.0)
    return out.select("clip_id", "donor", F.round("error", 6).alias("error"), "cut")


@query("c27_motion", "C27", f"""WITH {VSER}, p AS (SELECT *, lag(v) OVER (PARTITION BY clip_id ORDER BY t) AS u FROM vser)
SELECT clip_id, t, round(coalesce((SELECT avg(sqrt((v[2*i+1]-u[2*i+1])^2 + (v[2*i+2]-u[2*i+2])^2)) FROM range(0, 5) r(i))
    / ((greatest(0.05, sqrt((v[1]-v[3])^2 + (v[2]-v[4])^2)) + greatest(0.05, sqrt((u[1]-u[3])^2 + (u[2]-u[4])^2))) / 2), 0), 6) AS motion,
  round(coalesce((SELECT avg(abs(v[i] - u[i])) FROM range(11, 43) r(i)), 0), 6) AS appearance FROM p""")
def c27(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", "v")
    out = G.step_change(s, ["clip_id"], "t", lambda prev: {
        "motion": G.landmark_motion(F.col("v"), prev("v"), 0.05),
        "appearance": F.coalesce(V.mean_abs_diff(F.slice("v", 11, 32), F.slice(prev("v"), 11, 32)), LIT(0.0))})
    return out.select("clip_id", "t", F.round("motion", 6).alias("motion"), F.round("appearance", 6).alias("appearance"))


@query("c28_audio_change", "C28", f"""WITH {VSER}, p AS (SELECT *, lag(v) OVER w AS b1, lag(v, 2) OVER w AS b2, lead(v) OVER w AS a1 FROM vser WINDOW w AS (PARTITION BY clip_id ORDER BY t))
SELECT clip_id, t, round(coalesce((SELECT sqrt(avg(((v[i] + a1[i]) / 2 - (b1[i] + b2[i]) / 2)^2)) FROM range(1, 17) r(i)), 0), 6) AS change FROM p""")
def c28(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", "v")
    return G.spectrum_change(s, ["clip_id"], "t", "v", 16).select("clip_id", "t", F.round("change", 6).alias("change"))


@query("c29_robust_z", "C29", f"""WITH {SERIES}, c AS (SELECT a.clip_id, a.t, any_value(a.x) AS x, list(b.x) FILTER (abs(b.t - a.t) > 1 AND b.t >= 1) AS ctx FROM series a
  JOIN series b ON b.clip_id = a.clip_id AND b.t BETWEEN a.t - 25 AND a.t + 25 GROUP BY 1, 2),
m AS (SELECT *, list_median(ctx) AS med FROM c), d AS (SELECT *, list_median(list_transform(ctx, lambda y: abs(y - med))) * 1.4826 AS mad FROM m)
SELECT clip_id, t, round(CASE WHEN len(ctx) < 5 THEN 0 ELSE (x - med) / greatest(mad, 1e-4) END, 6) AS z FROM d""")
def c29(spark, sf):
    out = G.robust_z(frames(spark, sf).select("clip_id", "t", "x"), ["clip_id"], "t", "x")
    return out.select("clip_id", "t", F.round("z", 6).alias("z"))


def _z_sql(item: str) -> str:
    mad = f"list_median(list_transform({item}.k, lambda y: abs(y - list_median({item}.k)))) * 1.4826"
    return f"CASE WHEN {item}.v IS NULL THEN NULL WHEN len({item}.k) < 5 THEN 0.0 ELSE ({item}.v - list_median({item}.k)) / greatest({mad}, 1e-4) END"


def _own_sql(field: str, u: str) -> str:
    return f"{{'v': list_filter(ctx, lambda x: x.t = {u})[1].{field}, 'k': list_transform(list_filter(ctx, lambda x: abs(x.t - ({u})) > 1), lambda x: x.{field})}}"


JUMPS = f"""{VSER}, g AS (SELECT *, lag(v) OVER w AS u, lag(v, 2) OVER w AS b2, lead(v) OVER w AS a1 FROM vser WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
s AS (SELECT clip_id, t, coalesce((SELECT avg(sqrt((v[2*i+1]-u[2*i+1])^2 + (v[2*i+2]-u[2*i+2])^2)) FROM range(0, 5) r(i))
    / ((greatest(0.05, sqrt((v[1]-v[3])^2 + (v[2]-v[4])^2)) + greatest(0.05, sqrt((u[1]-u[3])^2 + (u[2]-u[4])^2))) / 2), 0) AS m,
  coalesce((SELECT avg(abs(v[i] - u[i])) FROM range(11, 43) r(i)), 0) AS p, coalesce((SELECT sqrt(avg(((v[i] + a1[i]) / 2 - (u[i] + b2[i]) / 2)^2)) FROM range(1, 17) r(i)), 0) AS c FROM g),
w AS (SELECT a.clip_id, a.t, any_value(a.m) AS m, list({{'t': b.t, 'm': b.m, 'p': b.p, 'c': b.c}} ORDER BY b.t) AS ctx FROM s a JOIN s b ON b.clip_id = a.clip_id AND b.t BETWEEN a.t - 25 AND a.t + 25 AND b.t >= 1 WHERE a.t >= 1 GROUP BY 1, 2),
z AS (SELECT *, {_own_sql('p', 't')} AS pz, [{_own_sql('c', 't - 1')}, {_own_sql('c', 't')}, {_own_sql('c', 't + 1')}] AS cz,
  greatest(coalesce(list_median(list_transform(list_filter(ctx, lambda x: abs(x.t - t) >= 3), lambda x: x.m)), 0), 0.06 / 1.3) AS base, list_max(list_transform(list_filter(ctx, lambda x: abs(x.t - t) BETWEEN 1 AND 2), lambda x: x.m)) AS calm FROM w),
f AS (SELECT clip_id, t, m >= greatest(0.06, 1.3 * base) AND (calm IS NULL OR calm <= 2.0 * base) AS spike, coalesce({_z_sql('pz')} >= 1.0, false) AS app,
  coalesce(list_max(list_transform(cz, lambda e: {_z_sql('e')})) >= 1.0, false) AS aud FROM z),
l AS (SELECT clip_id, t, CASE WHEN spike AND (app OR aud) THEN 'confident' WHEN spike OR (app AND aud) THEN 'suspect' END AS level FROM f),
j AS (SELECT clip_id, list({{'t': t, 'l': level}} ORDER BY t) AS found FROM l WHERE level IS NOT NULL GROUP BY 1),
kept AS (SELECT clip_id, unnest(list_reduce(list_prepend([{{'t': -10::BIGINT, 'l': ''}}], list_transform(found, lambda x: [x])), lambda a, x: CASE WHEN x[1].t - a[-1].t > 3 THEN list_concat(a, x) ELSE a END)[2:]) AS e FROM j)"""


@query("c30_jump_detect", "C30", f"WITH {JUMPS} SELECT clip_id, e.t AS t, e.l AS level FROM kept")
def c30(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", "v")
    s = G.step_change(s, ["clip_id"], "t", lambda prev: {
        "motion": G.landmark_motion(F.col("v"), prev("v"), 0.05),
        "appearance": F.coalesce(V.mean_abs_diff(F.slice("v", 11, 32), F.slice(prev("v"), 11, 32)), LIT(0.0))})
    s = G.spectrum_change(s, ["clip_id"], "t", "v", 16).drop("v")
    s = G.robust_z(G.robust_z(s, ["clip_id"], "t", "appearance", out="app_z"), ["clip_id"], "t", "change", out="audio_z", offsets=(-1, 0, 1))
    rules = {"landmark_ratio": 1.3, "calm_ratio": 2.0, "appearance_z": 1.0, "audio_z": 1.0}
    return G.detect_jumps(s, ["clip_id"], "t", rules)


HALVES = "halves AS (SELECT clip_id, t, v[1:32] AS a, v[33:64] AS b FROM vser)"


@query("c31_distance_curve", "C31", f"""WITH {VSER}, {HALVES}, l AS (SELECT unnest(range(-15, 16)) AS lag),
j AS (SELECT h.clip_id, lag, h.a, coalesce(o.b, list_transform(range(0, 32), lambda z: 0.0::DOUBLE)) AS b FROM halves h, l LEFT JOIN halves o ON o.clip_id = h.clip_id AND o.t = h.t + lag),
c AS (SELECT clip_id, lag, avg(list_distance(list_transform(b, lambda z: z + 1e-6), a)) AS d FROM j GROUP BY 1, 2)
SELECT clip_id, arg_min(lag, (d, lag)) AS lag, round(median(d) - min(d), 6) AS conf, round(sum(d), 5) AS total FROM c GROUP BY 1""")
def c31(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    curve = G.distance_curve(s, ["clip_id"], "t", "a", "b", 32)
    lag, conf = G.curve_stats(F.col("curve"), lowest=True)
    return curve.select("clip_id", lag.alias("lag"), F.round(conf, 6).alias("conf"), F.round(V.total(F.col("curve")), 5).alias("total"))


@query("c32_lag_curve", "C32", f"""WITH {VSER}, {HALVES}, l AS (SELECT unnest(range(-15, 16)) AS lag),
j AS (SELECT h.clip_id, lag, count(*) AS n, avg(list_dot_product(h.a, o.b) / ((sqrt(list_dot_product(h.a, h.a)) + 1e-8) * (sqrt(list_dot_product(o.b, o.b)) + 1e-8))) AS c
  FROM halves h JOIN l ON true JOIN halves o ON o.clip_id = h.clip_id AND o.t = h.t - lag GROUP BY 1, 2)
SELECT clip_id, arg_max(lag, (c, -lag)) AS lag, round(max(c) - median(c), 6) AS peak FROM j WHERE n >= 10 GROUP BY 1""")
def c32(spark, sf):
    s = vector_series(spark, sf).select("clip_id", "t", LIT(True).alias("ok"), F.slice("v", 1, 32).alias("a"), F.slice("v", 33, 32).alias("b"))
    out = G.lag_profile(G.lag_curve(s, ["clip_id"], "t", "a", "b", "ok"), ["clip_id"])
    return out.select("clip_id", "lag", F.round("peak", 6).alias("peak"))


@query("c33_summarize_sync", "C33", f"""WITH {MEASURED}, p AS (SELECT label, sample_id, unnest(dist) AS d, generate_subscripts(dist, 1) - 16 AS lag FROM measured),
own AS (SELECT label, sample_id, arg_min(lag, (d, lag)) AS lag FROM p GROUP BY 1, 2), mean AS (SELECT label, lag, avg(d) AS d FROM p GROUP BY 1, 2),
v AS (SELECT label, arg_min(lag, (d, lag)) AS lag, median(d) - min(d) AS conf FROM mean GROUP BY 1),
a AS (SELECT label, count(*) AS clips, avg((abs(own.lag - v.lag) <= 1)::INT) AS agree FROM own JOIN v USING (label) GROUP BY 1)
SELECT label, clips, lag, round(conf, 6) AS conf, round(agree, 6) AS agree, CASE WHEN conf < 0.02 OR agree < 0.1 THEN 'unreliable' WHEN clips >= 50 THEN 'ok' ELSE 'few' END AS status FROM v JOIN a USING (label)""")
def c33(spark, sf):
    out = G.summarize_curves(measured(spark, sf).select("label", "dist"), "label", "dist", 50, 0.02, 0.1)
    return out.select("label", "clips", "lag", F.round("conf", 6).alias("conf"), F.round("agree", 6).alias("agree"), "status")


@query("c34_shift", "C34", f"""WITH {SERIES}, k AS (SELECT unnest([3, -2]) AS k)
SELECT a.clip_id, a.t, k::BIGINT AS k, coalesce(b.value, 0) AS shifted, b.value IS NOT NULL AS lag_valid FROM series a JOIN k ON true LEFT JOIN series b ON b.clip_id = a.clip_id AND b.t = a.t - k""")
def c34(spark, sf):
    s = frames(spark, sf).select("clip_id", "t", "value")
    out = [G.shift(s, ["clip_id"], "t", "value", k).select("clip_id", "t", LIT(k).cast("long").alias("k"), "shifted", "lag_valid") for k in (3, -2)]
    return out[0].unionByName(out[1])


@query("c35_prosody", "C35", f"""WITH {SERIES}, s AS (SELECT clip_id, avg(x) FILTER (valid) AS m, stddev_pop(x) FILTER (valid) AS sd, count(*) FILTER (valid) AS n FROM series GROUP BY 1)
SELECT clip_id, t, round(CASE WHEN valid AND n >= 2 THEN (x - m) / (sd + 1e-6) ELSE 0 END, 6) AS z, round(coalesce(x - lag(x) OVER (PARTITION BY clip_id ORDER BY t), 0), 6) AS delta FROM series JOIN s USING (clip_id)""")
def c35(spark, sf):
    s = frames(spark, sf).select("clip_id", "t", "x", "valid")
    s = G.differences(s, ["clip_id"], "t", "x", 1)
    return G.masked_zscore(s, ["clip_id"], "x", F.col("valid")).select(
        "clip_id", "t", F.round("z", 6).alias("z"), F.round("d1", 6).alias("delta"))


def two_series(spark, sf):
    """x from the value, y from the JSON property of each event."""
    props = table(spark, sf, "events").select("event_id", F.sqrt(F.get_json_object("props", "$.k").cast("double")).alias("y"))
    return frames(spark, sf).join(props, "event_id").select("clip_id", "t", "x", "y", "valid")


COUPLING = f"""{SERIES}, two AS (SELECT s.clip_id, s.t, s.x, s.valid, sqrt((e.props ->> '$.k')::DOUBLE) AS y FROM series s JOIN events e USING (event_id)),
cl AS (SELECT unnest(range(-12, 13)) AS lag), cj AS (SELECT a.clip_id, lag, corr(a.x, b.y) AS c FROM two a JOIN cl ON true JOIN two b ON b.clip_id = a.clip_id AND b.t = a.t - lag
  WHERE a.valid AND b.valid GROUP BY 1, 2 HAVING count(*) >= 10 AND stddev_pop(a.x) >= 1e-6 AND stddev_pop(b.y) >= 1e-6),
coupled AS (SELECT clip_id, CASE WHEN count(*) >= 34 THEN (SELECT max(c) FROM cj WHERE cj.clip_id = two.clip_id) END AS coupling FROM two GROUP BY 1)"""


@query("c36_coupling", "C36", f"WITH {COUPLING} SELECT clip_id, round(coupling, 6) AS coupling FROM coupled")
def c36(spark, sf):
    out = G.coupling(two_series(spark, sf), ["clip_id"], "t", "x", "y", "valid")
    return out.select("clip_id", F.round("coupling", 6).alias("coupling"))


@query("c37_kinematics", "C37", f"""WITH {SERIES}, a AS (SELECT clip_id, t, x, coalesce(x - lag(x) OVER w, 0) AS d1 FROM series WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
b AS (SELECT *, coalesce(d1 - lag(d1) OVER w, 0) AS d2 FROM a WINDOW w AS (PARTITION BY clip_id ORDER BY t))
SELECT clip_id, t, round(d1, 6) AS d1, round(d2, 6) AS d2, round(coalesce(d2 - lag(d2) OVER w, 0), 6) AS d3 FROM b WINDOW w AS (PARTITION BY clip_id ORDER BY t)""")
def c37(spark, sf):
    out = G.differences(frames(spark, sf).select("clip_id", "t", "x"), ["clip_id"], "t", "x", 3)
    return out.select("clip_id", "t", *[F.round(d, 6).alias(d) for d in ("d1", "d2", "d3")])


@query("c38_normalized_landmarks", "C38", f"""WITH {VECTORS}, c AS (SELECT vec_id, v, (SELECT avg(v[2*i+1]) FROM range(0, 20) r(i)) AS cx, (SELECT avg(v[2*i+2]) FROM range(0, 20) r(i)) AS cy,
  greatest(1e-3, sqrt((v[13]-v[1])^2 + (v[14]-v[2])^2)) AS w FROM vectors)
SELECT vec_id, i, round((v[i + 1] - CASE WHEN i % 2 = 0 THEN cx ELSE cy END) / w, 6) AS p FROM c, range(0, 40) r(i)""")
def c38(spark, sf):
    rows = vectors(spark, sf).select("vec_id", F.posexplode(G.centred(F.col("v"), 40)).alias("i", "p"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


@query("c39_pooling", "C39", f"""WITH {SERIES}, r AS (SELECT clip_id, x - 6 AS s, row_number() OVER (PARTITION BY clip_id ORDER BY x - 6 DESC, event_id) AS r, count(*) OVER (PARTITION BY clip_id) AS n FROM series WHERE valid)
SELECT clip_id, round(avg(1 / (1 + exp(-s))) FILTER (r <= greatest(1, ceil(n * 0.1::DOUBLE))), 6) AS top_share, round(avg(1 / (1 + exp(-s))) FILTER (r <= 5), 6) AS top_k,
  round(max(s) + ln(sum(exp(s - m))), 6) AS lse, round(avg(s), 6) AS mean, round(max(s), 6) AS max FROM (SELECT *, max(s) OVER (PARTITION BY clip_id) AS m FROM r) GROUP BY 1""")
def c39(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).withColumn("s", F.col("x") - 6)
    out = G.pool(s, ["clip_id"], "s", "event_id", F.col("valid"), hot_rows=hot)
    return out.select("clip_id", *[F.round(c, 6).alias(c) for c in ("top_share", "top_k", "lse", "mean", "max")])


@query("c40_proposals", "C40")
def c40(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", "x")
    return G.proposals(s, ["clip_id"], "t", "x", hot_rows=hot)


_NEAR = """sqrt((x + w / 2 - lx - lw / 2)^2 + (y + h / 2 - ly - lh / 2)^2) < greatest(w, h) * 0.6 AND w / lw > 0.5 AND w / lw < 2"""
TRACK = f"""{SERIES}, rows_ AS (SELECT clip_id, event_id, t, CASE WHEN valid THEN 1 ELSE event_id % 2 * 2 END::INT AS faces, event_id % 17 <> 0 AS ok_geometry, x * 4 AS x, x * 2 AS y, 40 + x AS w, 40 + x AS h FROM series),
f AS (SELECT clip_id, t, faces = 1 AND ok_geometry AS valid, CASE WHEN faces = 1 AND ok_geometry THEN 0 ELSE 1 END AS missed, CASE WHEN faces = 1 AND ok_geometry THEN x END AS lx, CASE WHEN faces = 1 AND ok_geometry THEN y END AS ly,
    CASE WHEN faces = 1 AND ok_geometry THEN w END AS lw, CASE WHEN faces = 1 AND ok_geometry THEN h END AS lh FROM rows_ WHERE t = 0
  UNION ALL SELECT clip_id, t, ok, CASE WHEN ok THEN 0 ELSE missed + 1 END, CASE WHEN ok THEN x WHEN missed < 2 THEN lx END, CASE WHEN ok THEN y WHEN missed < 2 THEN ly END, CASE WHEN ok THEN w WHEN missed < 2 THEN lw END, CASE WHEN ok THEN h WHEN missed < 2 THEN lh END
  FROM (SELECT r.*, f.missed, lx, ly, lw, lh, faces = 1 AND ok_geometry AND (lw IS NULL OR ({_NEAR})) AS ok FROM f JOIN rows_ r ON r.clip_id = f.clip_id AND r.t = f.t + 1))"""


@query("c41_face_track", "C41", f"WITH RECURSIVE {TRACK} SELECT clip_id, t, faces, ok_geometry, x, y, w, h, valid FROM rows_ JOIN f USING (clip_id, t)")
def c41(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot)
    k = F.col("event_id")
    rows = s.select(
        "clip_id", "t", F.when(F.col("valid"), 1).otherwise((k % 2) * 2).cast("int").alias("faces"),
        (k % 17 != 0).alias("ok_geometry"), (F.col("x") * 4).alias("x"), (F.col("x") * 2).alias("y"),
        (40 + F.col("x")).alias("w"), (40 + F.col("x")).alias("h"))
    return G.track_faces(rows, ["clip_id"], "t", hot_rows=hot)


# Greedy picks in SQL: fold the frame numbers in order, keep those more than 3 away from all kept, at most 3.
PICKED = "list_reduce(list_prepend([-1000], list_transform({0}, lambda j: [j])), lambda t, j: CASE WHEN len(t) < 4 AND len(list_filter(t, lambda x: abs(x - j[1]) <= 3)) = 0 THEN t || j ELSE t END)[2:]"


@query("c42_frame_pick", "C42", f"""WITH {VSER}, s AS (SELECT clip_id, t // 175 AS part, t, list_transform(v[1:4], lambda x: abs(x)) AS r FROM vser),
i AS (SELECT *, row_number() OVER w - 1 AS i, sum((r[1] * 100 < 1)::INT) OVER w AS shut, list_transform(r, lambda x: trunc(x * 100)::INT) AS c FROM s WINDOW w AS (PARTITION BY clip_id, part ORDER BY t)),
p AS (SELECT *, row_number() OVER (PARTITION BY clip_id, part, shut ORDER BY t) - (shut > 0)::INT AS p FROM i),
k AS (SELECT k.clip_id, k.part, k.i, list(x.i ORDER BY x.i) AS alike FROM p k JOIN p x ON x.clip_id = k.clip_id AND x.part = k.part AND x.i <> k.i
  AND len(list_filter(range(1, 5), lambda z: k.c[z] - x.c[z] >= -3 AND k.c[z] - x.c[z] < 3)) = 4 WHERE k.p > 0 AND k.p % 5 = 0 GROUP BY ALL),
h AS (SELECT clip_id, part, min_by(i, i) AS k, min_by(g, i) AS g FROM (SELECT *, {PICKED.format('alike')} AS g FROM k) WHERE len(g) = 3 GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY clip_id, part) AS n, CASE WHEN count(*) OVER q = 5 THEN round(sum(r[1]) OVER q, 12) END AS o FROM p WINDOW q AS (PARTITION BY clip_id, part ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
m AS (SELECT clip_id, part, any_value(n) AS n, arg_max(i, (o, -i)) AS f FROM n WHERE o IS NOT NULL GROUP BY ALL HAVING any_value(n) >= 8),
z AS (SELECT m.clip_id, m.part, m.f, list(x.i ORDER BY round(list_sum(list_transform(range(1, 5), lambda q: abs(x.r[q] - l.r[q]))), 12), x.i) AS seq
  FROM m JOIN p x USING (clip_id, part) JOIN p l ON l.clip_id = m.clip_id AND l.part = m.part AND l.i = m.f + 4 WHERE x.i < m.f OR x.i >= m.f + 5 GROUP BY ALL),
y AS (SELECT *, {PICKED.format('seq')} AS g FROM z),
a AS (SELECT clip_id, part, range(k - 4, k + 1) AS l, g, false AS fallback FROM h UNION ALL
  SELECT clip_id, part, range(f, f + 5), (g || list_filter(seq, lambda j: NOT list_contains(g, j)))[1:3], true FROM y ANTI JOIN h USING (clip_id, part)),
u AS (SELECT clip_id, part, fallback, 'local' AS role, unnest(l) AS i FROM a UNION ALL SELECT clip_id, part, fallback, 'global', unnest(g) FROM a)
SELECT u.clip_id, u.part, p.t, u.role, u.fallback FROM u JOIN p USING (clip_id, part, i)""")
def c42(spark, sf):
    """A label's vectors in id order are cut into clips of 175 frames."""
    s = vector_series(spark, sf)
    rows = s.select("clip_id", F.floor(F.col("t") / 175).cast("long").alias("part"), "t",
                    *[F.abs(F.col("v")[i]).alias(f"r{i}") for i in range(4)])
    return G.pick_frames(rows, ["clip_id", "part"], "t")


@query("c43_identity_consistency", "C43", f"""WITH {VECTORS}, m AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM vectors, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
SELECT label, round(min(list_dot_product(v, m) / greatest(sqrt(list_dot_product(m, m)), 1e-8)), 6) AS consistency FROM vectors JOIN m USING (label) GROUP BY 1""")
def c43(spark, sf):
    out = G.consistency(vectors(spark, sf), ["label"], "v", 64)
    return out.select("label", F.round("consistency", 6).alias("consistency"))


@query("c44_batch_share", "C44", """
WITH f AS (SELECT o_custkey AS clip_id, min(o_orderkey) AS first FROM orders GROUP BY 1), p AS (SELECT clip_id, row_number() OVER (ORDER BY first, clip_id) - 1 AS p, count(*) OVER () AS n FROM f)
SELECT clip_id FROM p WHERE p >= 1 * n // 4 AND p < 2 * n // 4""")
def c44(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("clip_id"), "o_orderkey")
    return G.share_of_batches(o, "clip_id", "o_orderkey", 2, 4)


@query("c45_gap_injection", "C45", f"""WITH {SERIES}, n AS (SELECT clip_id, count(*) AS n, {hash_sql("'9:' || clip_id::VARCHAR")} AS h, {hash_sql("'9:' || clip_id::VARCHAR || ':gap'")} AS g, {hash_sql("'9:' || clip_id::VARCHAR || ':at'")} AS s FROM series GROUP BY 1),
c AS (SELECT *, CASE WHEN h % 2 = 1 AND least(5 + g % 21, n - 21) >= 5 THEN least(5 + g % 21, n - 21) END AS cut FROM n), a AS (SELECT *, CASE WHEN cut IS NOT NULL THEN 10 + s % (n - 20 - cut + 1) END AS at_ FROM c)
SELECT f.clip_id, CASE WHEN t >= at_ + cut THEN t - cut ELSE t END AS t, f.event_id, cut FROM series f JOIN a USING (clip_id) WHERE cut IS NULL OR t < at_ OR t >= at_ + cut""")
def c45(spark, sf):
    s = frames(spark, sf).select("clip_id", "t", "event_id")
    return G.inject_gap(s, ["clip_id"], "t", "9", 10, 5, 25).select("clip_id", "t", "event_id", "cut")


@query("d20_reference", "D20", f"""WITH {CLIPS}, j AS (SELECT c.clip_id, arg_min(d.clip_id, (d.source_id = c.source_id, -d.duration_s, d.clip_id)) AS r
  FROM clips c JOIN clips d ON d.split = c.split AND d.speaker_id = c.speaker_id AND d.clip_id <> c.clip_id GROUP BY 1)
SELECT c.clip_id, coalesce(r, c.clip_id) AS reference FROM clips c LEFT JOIN j USING (clip_id)""")
def d20(spark, sf):
    c = clips(spark, sf).select("split", "speaker_id", "clip_id", "source_id", "duration_s")
    return reference_of(c, ["split", "speaker_id"], "clip_id", "source_id", "duration_s").select("clip_id", "reference")
