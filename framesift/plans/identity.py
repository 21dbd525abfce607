"""Identity resolution."""

from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.functions.rules import add_flag
from framesift.operators import identity as P
from framesift.operators import living as L
from framesift.operators.joins import spread_join
from framesift.operators.signals import exact_quantiles
from framesift.plans.fixtures import VECTORS, vectors
from framesift.plans.registry import query
from framesift.session import table

LIT, SIZE = F.lit, 64
CENTRES = f"""{VECTORS}, sums AS (SELECT label, count(*) AS n, list(s ORDER BY i) AS s FROM (SELECT label, vec_id, i, v[i] AS e FROM vectors, range(1, 65) r(i)) x
  JOIN (SELECT label AS l2, i AS i2, sum(v[i]) AS s FROM vectors, range(1, 65) r(i) GROUP BY 1, 2) y ON x.label = y.l2 AND x.i = y.i2 WHERE vec_id = (SELECT min(vec_id) FROM vectors z WHERE z.label = x.label) GROUP BY label),
cnt AS (SELECT label, count(*) AS n FROM vectors GROUP BY 1),
centres AS (SELECT s.label AS speaker, cnt.n, s.s, list_transform(s.s, lambda x: x / greatest(sqrt(list_dot_product(s.s, s.s)), 1e-8)) AS c FROM sums s JOIN cnt ON cnt.label = s.label),
sims AS (SELECT vec_id, label, speaker, list_dot_product(v, c) AS sim FROM vectors, centres)"""


def registry(spark, sf):
    return P.centroids(vectors(spark, sf), "label", "v", SIZE).withColumnRenamed("label", "speaker")


@query("g12_centroids", "G12", f"WITH {CENTRES} SELECT speaker, n, i, round(c[i], 6) AS centre FROM centres, range(1, 65) r(i)")
def g12(spark, sf):
    rows = registry(spark, sf).select("speaker", "n", F.posexplode("centre").alias("i", "centre"))
    return rows.select("speaker", "n", (F.col("i") + 1).cast("long").alias("i"), F.round("centre", 6).alias("centre"))


@query("j11_top_matches", "J11", f"""WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, speaker) AS rank FROM sims)
SELECT vec_id, rank, speaker, round(sim, 6) AS sim FROM r WHERE rank <= 2""")
def j11(spark, sf):
    found = P.best_matches(vectors(spark, sf), "vec_id", "v", registry(spark, sf), "speaker", "centre", 2)
    return found.select("vec_id", "rank", "speaker", F.round("sim", 6).alias("sim"))


@query("v1_leader_clusters", "V1")
def v1(spark, sf):
    """One label is one input."""
    points = vectors(spark, sf).select(F.col("label").cast("string").alias("input"), "vec_id", "v")
    return P.leader_clusters(points, "input", "vec_id", "v", 0.2).select("input", "vec_id", "cluster")


@query("v2_registry_match", "V2", f"""WITH {CENTRES}, b AS (SELECT vec_id, arg_max(speaker, (round(sim, 12), -speaker)) AS best, max(sim) AS s1, list(sim ORDER BY sim DESC)[2] AS s2,
  arg_max(speaker, (round(sim, 12), -speaker)) FILTER (speaker % 3 = vec_id % 3) AS same, max(sim) FILTER (speaker % 3 = vec_id % 3) AS ss FROM sims GROUP BY 1),
k AS (SELECT *, coalesce(ss >= 0.25, false) AS ch, s1 >= 0.25 AND s1 - s2 >= 0.05 AS ov FROM b)
SELECT vec_id, CASE WHEN ch THEN same WHEN ov THEN best END AS matched, CASE WHEN ch THEN 'auto_channel' WHEN ov THEN 'auto' ELSE 'new' END AS assign,
  CASE WHEN NOT ch AND NOT ov AND s1 >= 0.15 THEN best END AS suggestion, round(s1, 6) AS sim FROM k""")
def v2(spark, sf):
    probes = vectors(spark, sf).select("vec_id", F.col("v").alias("face"), F.array(F.col("vec_id") % 3).alias("channels"))
    known = registry(spark, sf).select("speaker", F.col("centre").alias("face"), F.array(F.col("speaker") % 3).alias("channels"))
    out = P.match_registry(probes, "vec_id", known, "speaker", {"high": 0.25, "low": 0.15, "margin": 0.05})
    return out.withColumn("sim", F.round("sim", 6))


@query("v3_registry_update", "V3", f"""WITH {VECTORS}, old AS (SELECT label, count(*) AS n FROM vectors WHERE vec_id % 2 = 0 AND label < 8 GROUP BY 1), new AS (SELECT *, vec_id % 4 AS video, v[1] AS q FROM vectors WHERE vec_id % 2 = 1),
ph AS (SELECT label, string_agg(video::VARCHAR, ',' ORDER BY q DESC, video) AS photos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY q DESC, video) AS r FROM (SELECT label, video, max(q) AS q FROM new GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1),
al AS (SELECT label, sum(v[1]) AS s1, sum(v[64]) AS s64, count(*) AS n FROM (SELECT * FROM vectors WHERE vec_id % 2 = 1 OR label < 8) GROUP BY 1), ch AS (SELECT label, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN label < 8 THEN [label % 3] ELSE [] END, list(vec_id % 5)))), ',') AS channels FROM new GROUP BY label)
SELECT al.label AS speaker, al.n AS face_n, round(s1, 6) AS first, round(s64, 6) AS last, channels, photos, CASE WHEN al.label >= 8 THEN 'pending' WHEN al.label % 2 = 0 THEN CASE WHEN old.n < 25 THEN 'pending' ELSE 'done' END ELSE 'excluded' END AS review,
  CASE WHEN al.label < 8 THEN al.label + 1 ELSE 8 + al.label - 7 END AS order_key FROM al LEFT JOIN old USING (label) JOIN ph USING (label) JOIN ch USING (label)""")
def v3(spark, sf):
    v = vectors(spark, sf)
    old = P.centroids(v.where("vec_id % 2 = 0 AND label < 8"), "label", "v", SIZE).select(
        F.col("label").alias("speaker"), F.col("sum").alias("face_sum"), F.col("n").alias("face_n"), F.array(F.col("label") % 3).alias("channels"),
        F.when(F.col("label") % 2 == 0, LIT("done")).otherwise(LIT("excluded")).alias("review"), F.col("n").alias("kept"), (F.col("label") + 1).alias("order_key"))
    new = v.where("vec_id % 2 = 1").select(F.col("label").alias("speaker"), F.col("v").alias("face"), (F.col("vec_id") % 5).alias("channel"),
                                           (F.col("vec_id") % 4).alias("video"), F.col("v")[0].alias("quality"))
    out = P.update_registry(old, new, "speaker", SIZE, 3, 25)
    return out.select("speaker", F.col("face_n").cast("long").alias("face_n"), F.round(F.col("face_sum")[0], 6).alias("first"), F.round(F.col("face_sum")[63], 6).alias("last"),
                      F.array_join("channels", ",").alias("channels"), F.array_join("photos", ",").alias("photos"), "review", "order_key")


@query("v4_identify_batch", "V4")
def v4(spark, sf):
    """Cluster every input, match the cluster centres, keep small unmatched clusters unassigned."""
    points = vectors(spark, sf).select(F.col("label").cast("string").alias("input"), "vec_id", "v")
    clustered = P.leader_clusters(points, "input", "vec_id", "v", 0.2).withColumn("probe", F.concat_ws("/", "input", "cluster"))
    centres = P.centroids(clustered, "probe", "v", SIZE)
    probes = centres.select("probe", "n", F.col("centre").alias("face"), F.array().cast("array<bigint>").alias("channels"))
    known = registry(spark, sf).select("speaker", F.col("centre").alias("face"), F.array("speaker").alias("channels"))
    found = P.match_registry(probes, "probe", known, "speaker", {"high": 0.5, "low": 0.3, "margin": 0.05})
    sized = found.join(centres.select("probe", "n", "centre"), "probe")
    assign = F.when((F.col("assign") == "new") & (F.col("n") < 3), LIT("unassigned")).otherwise(F.col("assign"))
    rows = clustered.join(sized, "probe")
    outlier = F.when((V.dot(F.col("v"), F.col("centre")) < 0.35) & (assign != "unassigned"), LIT("face_outlier"))
    return rows.select("vec_id", "probe", assign.alias("assign"), F.when(assign != "unassigned", F.col("matched")).alias("speaker"),
                       add_flag(LIT(""), outlier).alias("flags"))


def living_clips(spark, sf):
    """Three rounds of eight one-speaker inputs; a seventh of the clips has no voice."""
    k = F.col("vec_id") % 24
    voice = F.when(F.col("vec_id") % 7 != 0, F.reverse("v"))
    return vectors(spark, sf).select(
        F.floor(k / 8).cast("long").alias("round"), F.concat(LIT("i"), k).alias("input_id"), LIT(True).alias("one"), F.col("vec_id").alias("clip_id"), F.col("v").alias("face"),
        voice.alias("voice"), F.concat(LIT("c"), k % 5).alias("channel"), F.concat(LIT("w"), F.col("vec_id") % 3).alias("video"), F.col("v")[0].alias("quality"))


LIVING_RULES = L.Rules({"high": 0.2, "low": 0.1, "margin": 0.02, "voice_low": -0.05}, photos=2, voice_outlier=0.3)


def living_sql() -> str:
    """The rounds unrolled: each matches its inputs with the speakers of the rounds before."""
    total = lambda c, f="": f"list_transform(range(1, 65), lambda i: list_sum(list_transform(list({c}){f}, lambda x: x[i])))"
    unit_ = lambda c: f"list_transform({c}, lambda x: x / greatest(sqrt(list_sum(list_transform({c}, lambda y: y * y))), 1e-8))"
    parts = [f"""{VECTORS}, c AS (SELECT vec_id, vec_id % 24 AS k, vec_id % 24 // 8 AS round, v, CASE WHEN vec_id % 7 <> 0 THEN list_reverse(v) END AS w, vec_id % 24 % 5 AS ch FROM vectors),
g AS (SELECT k, any_value(round) AS round, any_value(ch) AS ch, count(*) AS n, {total('v')} AS fs, count(w) AS vn, {total('w', ' FILTER (w IS NOT NULL)')} AS vs FROM c GROUP BY k),
p AS (SELECT *, 'i' || k AS input_id, {unit_('fs')} AS face, CASE WHEN vn > 0 THEN {unit_('vs')} END AS voice FROM g),
r0 AS (SELECT NULL::BIGINT AS speaker, NULL::DOUBLE[] AS fs, 0::BIGINT AS n, NULL::DOUBLE[] AS vs, 0::BIGINT AS vn, NULL::BIGINT[] AS chs, NULL::BIGINT AS hint WHERE false)"""]
    for i in range(3):
        parts.append(f"""s{i} AS (SELECT p.k, r.speaker, list_dot_product(p.face, {unit_('r.fs')}) AS sim, list_contains(r.chs, p.ch) AS same,
  coalesce(CASE WHEN r.vn > 0 THEN list_dot_product(p.voice, {unit_('r.vs')}) >= -0.05 END, true) AS ok FROM p, r{i} r WHERE p.round = {i}),
b{i} AS (SELECT k, arg_max(speaker, sim) AS best, max(sim) AS s1, coalesce(list(sim ORDER BY sim DESC)[2], -1.0) AS s2, arg_max(ok, sim) AS ok1,
  arg_max(speaker, sim) FILTER (same) AS sb, max(sim) FILTER (same) AS ss, arg_max(ok, sim) FILTER (same) AS ok2 FROM s{i} GROUP BY k),
d{i} AS (SELECT p.*, best, coalesce(ss >= 0.2 AND ok2, false) AS ch_, coalesce(s1 >= 0.2 AND s1 - s2 >= 0.02 AND ok1, false) AS ov, sb, s1 FROM p LEFT JOIN b{i} USING (k) WHERE p.round = {i}),
e{i} AS (SELECT *, CASE WHEN ch_ THEN sb WHEN ov THEN best END AS matched, CASE WHEN ch_ THEN 'auto_channel' WHEN ov THEN 'auto' ELSE 'new' END AS how,
  CASE WHEN NOT ch_ AND NOT ov AND s1 >= 0.1 THEN best END AS hint FROM d{i}),
a{i} AS (SELECT *, CASE WHEN matched IS NULL AND n < 3 THEN NULL WHEN matched IS NULL THEN (SELECT coalesce(max(speaker), 0) FROM r{i}) + row_number() OVER (PARTITION BY matched IS NULL AND n >= 3 ORDER BY input_id) ELSE matched END AS speaker FROM e{i}),
u{i} AS (SELECT speaker, fs, n, vs, vn, chs, hint FROM r{i} UNION ALL SELECT speaker, fs, n, vs, vn, [ch], CASE WHEN matched IS NULL THEN hint END FROM a{i} WHERE speaker IS NOT NULL),
r{i + 1} AS (SELECT speaker, {total('fs')} AS fs, sum(n)::BIGINT AS n, CASE WHEN sum(vn) > 0 THEN {total('vs', ' FILTER (vn > 0)')} END AS vs, sum(vn)::BIGINT AS vn,
  list_sort(list_distinct(flatten(list(chs)))) AS chs, max(hint) AS hint FROM u{i} GROUP BY speaker)""")
    parts.append(f"al AS ({' UNION ALL '.join(f'SELECT k, input_id, speaker, how, face, voice FROM a{i}' for i in range(3))})")
    return "WITH " + ",\n".join(parts)


@query("v4_living_registry", "V4", f"""{living_sql()} SELECT vec_id AS clip_id, input_id, speaker, CASE WHEN speaker IS NULL THEN 'unassigned' ELSE how END AS assign,
CASE WHEN speaker IS NULL THEN '' ELSE concat_ws(',', CASE WHEN list_dot_product(v, face) < 0.35 THEN 'face_outlier' END, CASE WHEN list_sum(list_transform(range(1, 65), lambda i: w[i] * voice[i])) < 0.3 THEN 'voice_outlier' END) END AS flags FROM c JOIN al USING (k)""")
def v4_living(spark, sf):
    """Match, create and add, round after round: clips with their speakers."""
    out = L.identify(living_clips(spark, sf), L.Store(spark), SIZE, LIVING_RULES)
    return out.select("clip_id", "input_id", "speaker", "assign", "flags")


@query("v3_living_speakers", "V3", f"""{living_sql()} SELECT speaker, n AS face_n, round(fs[1], 6) AS first, vn AS voice_n, round(coalesce(vs[1], 0), 6) AS voice_first, array_to_string(list_transform(chs, lambda x: 'c' || x), ',') AS channels, hint AS suggestion FROM r3""")
def v3_living(spark, sf):
    """The registry after the three rounds."""
    store = L.Store(spark)
    L.identify(living_clips(spark, sf), store, SIZE, LIVING_RULES)
    return store.before(4).select("speaker", "face_n", F.round(F.col("face_sum")[0], 6).alias("first"), "voice_n", F.round(F.coalesce(F.col("voice_sum")[0], LIT(0.0)), 6).alias("voice_first"),
                                  F.array_join("channels", ",").alias("channels"), "suggestion")


@query("v5_outlier_flags", "V5", f"""WITH {CENTRES} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN sim < 0.1 THEN 'face_outlier,jump_suspect' ELSE 'jump_suspect' END ELSE CASE WHEN sim < 0.1 THEN 'face_outlier' ELSE '' END END AS flags
FROM sims WHERE speaker = label""")
def v5(spark, sf):
    own = spread_join(vectors(spark, sf), registry(spark, sf).select(F.col("speaker").alias("label"), "centre"), ["label"], "inner", ["vec_id"])
    flag = F.when(V.dot(F.col("v"), F.col("centre")) < 0.1, LIT("face_outlier"))
    given = F.when(F.col("vec_id") % 3 == 0, LIT("jump_suspect,,jump_suspect")).otherwise(LIT(""))
    return own.select("vec_id", add_flag(given, flag).alias("flags"))


@query("v6_calibrate", "V6", f"""WITH {CENTRES}, k AS (SELECT vec_id, max(sim) FILTER (speaker = label) AS own, max(sim) FILTER (speaker <> label) AS other FROM sims GROUP BY 1)
SELECT count(*) AS clips, round(quantile_cont(own, 0.01), 6) AS own_p1, round(quantile_cont(own, 0.05), 6) AS own_p5, round(quantile_cont(own, 0.5), 6) AS own_p50, round(quantile_cont(other, 0.5), 6) AS other_p50,
  round(quantile_cont(other, 0.95), 6) AS suggest_low, round(greatest(quantile_cont(other, 0.99) + 0.05, 0.3), 6) AS suggest_high FROM k""")
def v6(spark, sf):
    v, known = vectors(spark, sf), registry(spark, sf)
    best = P.best_matches(v, "vec_id", "v", known, "speaker", "centre", 1, own="label").select(F.col("sim").alias("other"), LIT(0).alias("z"))
    own = v.join(known.select(F.col("speaker").alias("label"), "centre"), "label").select(V.dot(F.col("v"), F.col("centre")).alias("own"), LIT(0).alias("z"))
    a = exact_quantiles(own, ["z"], "own", {"own_p1": 0.01, "own_p5": 0.05, "own_p50": 0.5}).withColumnRenamed("n", "clips")
    b = exact_quantiles(best, ["z"], "other", {"other_p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    r = a.join(b, "z")
    cols = {c: F.col(c) for c in ("own_p1", "own_p5", "own_p50", "other_p50")}
    cols |= {"suggest_low": F.col("p95"), "suggest_high": F.greatest(F.col("p99") + 0.05, LIT(0.3))}
    return r.select("clips", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("v7_nearest_three", "V7", f"""WITH {CENTRES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, speaker) AS rank FROM sims WHERE speaker <> label)
SELECT vec_id, rank, speaker, round(sim, 6) AS sim FROM r WHERE rank <= 3""")
def v7(spark, sf):
    found = P.best_matches(vectors(spark, sf), "vec_id", "v", registry(spark, sf), "speaker", "centre", 3, own="label")
    return found.select("vec_id", "rank", "speaker", F.round("sim", 6).alias("sim"))


@query("v8_merge_move", "V8", f"""WITH {VECTORS}, mv AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l2 FROM vectors), mg AS (SELECT *, CASE WHEN l2 = 9 THEN 0 WHEN l2 = 8 THEN 1 ELSE l2 END AS l3 FROM mv)
SELECT l3::BIGINT AS speaker, count(*) AS face_n, round(sum(v[1]), 6) AS first, (SELECT count(*) FROM vectors w WHERE CASE WHEN w.label = 9 THEN 0 WHEN w.label = 8 THEN 1 ELSE w.label END = l3 AND (w.label >= 8 OR w.vec_id % 2 = 1)) AS pending FROM mg GROUP BY l3""")
def v8(spark, sf):
    v = vectors(spark, sf)
    known = registry(spark, sf).select("speaker", F.col("sum").alias("face_sum"), F.col("n").alias("face_n"))
    moves = v.where("vec_id % 7 = 0").select(F.col("label").alias("from_key"), ((F.col("label") + 1) % 10).alias("to_key"), F.col("v").alias("face"))
    moved = P.move_clips(known, moves, "speaker", SIZE)
    merges = moved.where("speaker >= 8").select("speaker", F.when(F.col("speaker") == 9, LIT(0)).otherwise(LIT(1)).cast("long").alias("into"))
    rows = v.select(F.col("label").alias("speaker"), F.when(F.col("vec_id") % 2 == 0, LIT("keep")).otherwise(LIT("pending")).alias("decision"))
    sums, after = P.merge_speakers(moved, merges, rows, "speaker", SIZE)
    waiting = after.where("decision = 'pending'").groupBy("speaker").agg(F.count(LIT(1)).alias("pending"))
    return sums.join(waiting, "speaker").select("speaker", "face_n", F.round(F.col("face_sum")[0], 6).alias("first"), "pending")


@query("v9_decision_cap", "V9", """
WITH e AS (SELECT *, event_type IN ('click', 'view') AS keep FROM events), r AS (SELECT *, sum(keep::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT event_id, NOT keep OR k <= 12 AS accepted FROM r""")
def v9(spark, sf):
    keep = F.when(F.col("event_type").isin("click", "view"), LIT("keep")).otherwise(LIT("reject"))
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", keep.alias("decision"))
    return P.cap_decisions(e, "user_id", ["ts", "event_id"], 12).select("event_id", "accepted")
