"""Intervals and sequences."""

from pyspark.sql import functions as F

from framesift.functions import rules as R
from framesift.functions import spans as S
from framesift.operators import intervals as I
from framesift.operators.ordered import merge_spans, previous, runs
from framesift.plans.fixtures import CLIPS, SERIES, SPANS, clips, event_limit, series, spans
from framesift.plans.registry import query
from framesift.session import table

LIT = F.lit


def runs_sql(flag: str, source: str = "series") -> str:
    """Islands of a flag as (clip_id, start, stop)."""
    return f"""(SELECT clip_id, min(t) AS start, max(t) + 1 AS stop FROM (
      SELECT clip_id, t, t - row_number() OVER (PARTITION BY clip_id ORDER BY t) AS g FROM {source} WHERE {flag})
      GROUP BY clip_id, g)"""


def union_sql(source: str, gap: str, keys: str = "clip_id") -> str:
    return f"""(SELECT {keys}, min(a) AS a, max(b) AS b FROM (
      SELECT *, sum(CASE WHEN e IS NULL OR a > e + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {source}))
      GROUP BY {keys}, g)"""


@query("c1_interval_union", "C1", f"""WITH {SPANS}
SELECT clip_id, round(a, 4) AS a, round(b, 4) AS b FROM {union_sql('spans', '1e-9')}""")
def c1(spark, sf):
    merged = merge_spans(spans(spark, sf), ["clip_id"], "a", "b", 1e-9)
    return merged.select("clip_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


MARKS = """marks AS (SELECT clip_id, CASE WHEN clip_id % 10 = 0 AND kind = 'R' THEN 'lip_audio_mismatch'
    ELSE CASE kind WHEN 'A' THEN 'phoneme_viseme' WHEN 'N' THEN 'sequence' ELSE 'motion_speech' END END AS name, role,
    CASE WHEN role = 'known' THEN a ELSE a + (b - a) * 0.75 END AS a, b
  FROM spans, (VALUES ('known'), ('positive')) r(role))"""


def marks(spark, sf):
    s = spans(spark, sf)
    name = F.when((F.col("clip_id") % 10 == 0) & (F.col("kind") == "R"), LIT("lip_audio_mismatch")).otherwise(
        F.when(F.col("kind") == "A", LIT("phoneme_viseme")).when(F.col("kind") == "N", LIT("sequence"))
        .otherwise(LIT("motion_speech")))
    s = s.withColumn("name", name).withColumn("role", F.explode(F.array(LIT("known"), LIT("positive"))))
    return s.select("clip_id", "name", "role",
                    F.when(F.col("role") == "known", F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * 0.75).alias("a"), "b")


@query("c2_mismatch_sweep", "C2", f"""WITH {SPANS}, {MARKS},
x AS (SELECT DISTINCT clip_id FROM marks WHERE name = 'lip_audio_mismatch'),
own AS (SELECT * FROM marks WHERE clip_id NOT IN (SELECT clip_id FROM x)),
bnd AS (SELECT clip_id, a AS t FROM own UNION SELECT clip_id, b FROM own
  UNION SELECT o_orderkey, unnest([0.0::DOUBLE, 200.0::DOUBLE]) FROM orders WHERE o_orderkey NOT IN (SELECT clip_id FROM x)),
seg AS (SELECT clip_id, t AS a, lead(t) OVER (PARTITION BY clip_id ORDER BY t) AS b FROM bnd),
j AS (SELECT s.clip_id, s.a, s.b, count(DISTINCT m.name) FILTER (m.role = 'known') AS k, count(*) FILTER (m.role = 'positive') AS p
  FROM seg s LEFT JOIN own m ON m.clip_id = s.clip_id AND m.a <= (s.a + s.b) / 2 AND (s.a + s.b) / 2 < m.b WHERE s.b IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT clip_id, 'known' AS role, a, b FROM j WHERE p > 0 OR k = 3 UNION ALL SELECT clip_id, 'positive', a, b FROM j WHERE p > 0)
SELECT clip_id, role, round(a, 4) AS a, round(b, 4) AS b FROM {union_sql('v', '1e-8', 'clip_id, role')}
UNION ALL SELECT clip_id, role, round(a, 4), round(b, 4) FROM marks WHERE name = 'lip_audio_mismatch'""")
def c2(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), LIT(200.0).alias("duration"))
    return I.mismatch_sweep(c, marks(spark, sf)).select(
        "clip_id", "role", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("c3_temporal_targets", "C3", f"""WITH {SPANS},
g AS (SELECT o_orderkey AS clip_id, o_orderkey % 13 <> 0 AS known, unnest(range(0, 27)) AS cell FROM orders),
o AS (SELECT g.clip_id, g.cell, sum(greatest(0.0, least(least((cell + 1) * 5.0::DOUBLE, 132.0::DOUBLE), b) - greatest(cell * 5.0::DOUBLE, a))
      / greatest(least((cell + 1) * 5.0::DOUBLE, 132.0::DOUBLE) - cell * 5.0::DOUBLE, 1e-6)) AS c
  FROM g JOIN spans s ON s.clip_id = g.clip_id GROUP BY 1, 2)
SELECT clip_id, count(*) AS cells, round(sum(CASE WHEN NOT known THEN -1.0::DOUBLE ELSE least(coalesce(c, 0), 1.0::DOUBLE) END), 5) AS total,
  count(*) FILTER (known AND c > 0.5 + 1e-9) AS high FROM g LEFT JOIN o USING (clip_id, cell) GROUP BY clip_id""")
def c3(spark, sf):
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(k.alias("clip_id"), LIT(132.0).alias("duration"), (k % 13 != 0).alias("known"))
    cells = I.cell_cover(c, spans(spark, sf).select("clip_id", "a", "b"), 5.0)
    return cells.groupBy("clip_id").agg(
        F.count(LIT(1)).alias("cells"), F.round(F.sum("target"), 5).alias("total"),
        F.count(F.when(F.col("target") > 0.5 + 1e-9, 1)).alias("high"))


@query("c4_covers_whole", "C4", f"""WITH {SPANS}
SELECT clip_id, sum(b - a) >= 12.0 - 0.04 - 1e-9 AS whole FROM spans GROUP BY clip_id""")
def c4(spark, sf):
    whole = F.sum(F.col("b") - F.col("a")) >= 12.0 - 0.04 - 1e-9
    return spans(spark, sf).groupBy("clip_id").agg(whole.alias("whole"))


@query("c5_iou", "C5", f"""WITH {SPANS}, p AS (SELECT *, lag(a) OVER w AS c, lag(b) OVER w AS d FROM spans WINDOW w AS (PARTITION BY clip_id ORDER BY a, b, kind))
SELECT clip_id, a, b, round(CASE WHEN greatest(b, d) > least(a, c) THEN greatest(0.0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c)) ELSE 0.0 END, 6) AS iou
FROM p WHERE c IS NOT NULL""")
def c5(spark, sf):
    p = previous(spans(spark, sf), ["clip_id"], ["a", "b", "kind"], {"c": "a", "d": "b"}).where("c IS NOT NULL")
    return p.select("clip_id", "a", "b", F.round(S.iou(*[F.col(x) for x in "abcd"]), 6).alias("iou"))


REGIONS = f"""n AS (SELECT clip_id, count(*) * 0.032::DOUBLE AS duration FROM series GROUP BY clip_id),
r0 AS (SELECT clip_id, start * 0.032::DOUBLE AS a, stop * 0.032::DOUBLE AS b FROM {runs_sql('value >= 30')}),
r1 AS (SELECT clip_id, a, least(b, duration) AS b, duration FROM {union_sql('r0', '0.04::DOUBLE')} JOIN n USING (clip_id)),
r2 AS (SELECT clip_id, greatest(0.0, a - 0.03::DOUBLE) AS a, least(duration, b + 0.03::DOUBLE) AS b FROM r1 WHERE b - a >= 0.1),
regions AS (SELECT * FROM {union_sql('r2', '0.0')})"""


def regions(spark, sf, s, hot):
    durations = s.groupBy("clip_id").agg((F.count(LIT(1)) * 0.032).alias("duration"))
    return I.speech_regions(s, ["clip_id"], "t", F.col("value") >= 30, durations, silence=0.04, pad=0.03, shortest=0.1,
                            hot_rows=hot)


@query("c6_speech_regions", "C6", f"WITH {SERIES}, {REGIONS} SELECT clip_id, round(a, 4) AS a, round(b, 4) AS b FROM regions")
def c6(spark, sf):
    hot = event_limit(spark, sf)
    out = regions(spark, sf, series(spark, sf, hot), hot)
    return out.select("clip_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("c7_pause_spans", "C7", f"""WITH {SERIES}, {REGIONS},
p AS (SELECT clip_id, start * 0.032::DOUBLE AS p, stop * 0.032::DOUBLE AS q FROM {runs_sql('value < 30')})
SELECT p.clip_id, round(p, 3) AS a, round(q, 3) AS b FROM p WHERE EXISTS (SELECT 1 FROM regions r WHERE r.clip_id = p.clip_id AND r.a < p AND q < r.b)""")
def c7(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot)
    return I.pauses_inside(s, regions(spark, sf, s, hot), ["clip_id"], "t", F.col("value") < 30, hot_rows=hot)


@query("c8_runs", "C8", f"WITH {SERIES} SELECT * FROM {runs_sql('valid')}")
def c8(spark, sf):
    return runs(series(spark, sf), ["clip_id"], "t", F.col("valid"))


def hours(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", "value", (F.col("event_type") != "error").alias("valid"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / LIT(3.6e9) - LIT(473352.0)).alias("h"))


HOURS = """hours AS (SELECT user_id AS clip_id, event_id, value, event_type <> 'error' AS valid,
  epoch_us(ts) / 3.6e9::DOUBLE - 473352.0::DOUBLE AS h FROM events)"""


def gaps(spark, sf, hot):
    """Pauses between neighbouring events of a user: (clip_id, mid, length)."""
    g = previous(hours(spark, sf), ["clip_id"], ["h", "event_id"], {"p": "h"}, hot).where("p IS NOT NULL")
    return g.select("clip_id", ((F.col("h") + F.col("p")) / 2).alias("mid"), (F.col("h") - F.col("p")).alias("length"))


@query("c9_plan_clips", "C9")
def c9(spark, sf):
    """Speech = events merged over gaps of 12 h; scene bounds at events marked error."""
    h, hot = hours(spark, sf), event_limit(spark, sf)
    speech = merge_spans(h.select("clip_id", F.col("h").alias("a"), (F.col("h") + 1).alias("b")), ["clip_id"], "a", "b", 12.0, hot)
    videos = h.groupBy("clip_id").agg((F.max("h") + 1).alias("duration"))
    scenes = h.where("NOT valid AND value > 100").select("clip_id", F.col("h").alias("t"))
    return I.plan_clips(speech, scenes, gaps(spark, sf, hot), videos, "clip_id", hot_rows=hot)


@query("c10_best_pause", "C10", f"""WITH {HOURS},
g AS (SELECT clip_id, (h + p) / 2 AS mid, h - p AS length FROM (SELECT *, lag(h) OVER (PARTITION BY clip_id ORDER BY h, event_id) AS p FROM hours) WHERE p IS NOT NULL),
w AS (SELECT DISTINCT clip_id, floor(h / 24) * 24.0::DOUBLE AS lo, floor(h / 24) * 24.0::DOUBLE + 18 AS hi FROM hours),
m AS (SELECT w.clip_id, lo, hi, arg_max(mid, (length, mid)) AS mid FROM w JOIN g ON g.clip_id = w.clip_id AND mid >= lo - 1e-6 AND mid <= hi + 1e-6 GROUP BY 1, 2, 3)
SELECT w.clip_id, w.lo, w.hi, round(coalesce(least(greatest(round_even(mid * 25, 0) / 25, w.lo), w.hi), w.hi), 6) AS cut FROM w LEFT JOIN m USING (clip_id, lo, hi)""")
def c10(spark, sf):
    day = F.floor(F.col("h") / 24) * 24.0
    w = hours(spark, sf).select("clip_id", day.alias("lo"), (day + 18).alias("hi")).distinct()
    return I.best_cut(w, gaps(spark, sf, event_limit(spark, sf)), ["clip_id"], 24.0).select("clip_id", "lo", "hi", F.round("cut", 6).alias("cut"))


@query("c11_coverage_gate", "C11", f"""WITH {HOURS},
w AS (SELECT DISTINCT clip_id, floor(h / 48) * 48.0::DOUBLE AS a, floor(h / 48) * 48.0::DOUBLE + 48 AS b FROM hours),
j AS (SELECT w.clip_id, w.a, w.b, count(h) AS inside, coalesce(sum(valid::INT), 0)::BIGINT AS good FROM w LEFT JOIN hours e ON e.clip_id = w.clip_id AND h >= a AND h < b GROUP BY 1, 2, 3)
SELECT *, CASE WHEN inside / greatest(1.0::DOUBLE, (b - a) * 0.1::DOUBLE) < 0.8 OR good / greatest(1, inside) < 0.7 THEN 'face_scan' END AS reason FROM j""")
def c11(spark, sf):
    h = hours(spark, sf)
    a = F.floor(F.col("h") / 48) * 48.0
    w = h.select("clip_id", a.alias("a"), (a + 48).alias("b")).distinct()
    return I.coverage_gate(w, h, ["clip_id"], "h", F.col("valid"), 0.1, 0.7, 48.0)


@query("c12_bad_run_gate", "C12", f"""WITH {SERIES}, l AS (SELECT clip_id, max(stop - start) AS longest FROM {runs_sql('NOT valid')} GROUP BY 1),
n AS (SELECT clip_id, count(*) AS n, count(*) FILTER (NOT valid) AS bad FROM series GROUP BY 1)
SELECT clip_id, n, bad, coalesce(longest, 0) AS longest, 70::BIGINT AS expected, CASE WHEN bad > 14 OR coalesce(longest, 0) > 3 THEN 'face_frame'
  WHEN n < 70 * 0.95 THEN 'coverage' END AS reason FROM n LEFT JOIN l USING (clip_id)""")
def c12(spark, sf):
    s = series(spark, sf)
    expected = s.select("clip_id").distinct().withColumn("expected", LIT(70).cast("long"))
    return I.bad_run_gate(s, ["clip_id"], "t", ~F.col("valid"), expected, 14, 3)


@query("c13_fill_gaps", "C13", f"""WITH {SERIES}, k AS (SELECT clip_id, t, CASE WHEN valid THEN x END AS v FROM series),
f AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY clip_id ORDER BY t) AS bt,
  min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_ FROM k)
SELECT f.clip_id, f.t, round(CASE WHEN f.v IS NOT NULL THEN f.v WHEN b.v IS NULL AND a.v IS NULL THEN 0 WHEN b.v IS NULL THEN a.v WHEN a.v IS NULL THEN b.v
  ELSE (1 - (f.t - bt) / (at_ - bt)) * b.v + (f.t - bt) / (at_ - bt) * a.v END, 6) AS filled
FROM f LEFT JOIN k b ON b.clip_id = f.clip_id AND b.t = f.bt LEFT JOIN k a ON a.clip_id = f.clip_id AND a.t = f.at_""")
def c13(spark, sf):
    hot = event_limit(spark, sf)
    s = series(spark, sf, hot).select("clip_id", "t", F.when(F.col("valid"), F.col("x")).alias("v"))
    return I.fill_gaps(s, ["clip_id"], "t", "v", "filled", hot).select("clip_id", "t", F.round("filled", 6).alias("filled"))


@query("c14_fill_blocks", "C14", f"""WITH {HOURS},
f AS (SELECT clip_id, floor(h / 6)::BIGINT AS block, arg_min(value, (h, event_id)) AS value, count(*) - 1 AS skipped FROM hours GROUP BY 1, 2),
g AS (SELECT clip_id, unnest(range(min(block), max(block) + 1)) AS block FROM f GROUP BY clip_id)
SELECT clip_id, block, coalesce(value, 0) AS value, coalesce(skipped, 0) AS skipped FROM g LEFT JOIN f USING (clip_id, block)""")
def c14(spark, sf):
    return I.fill_blocks(hours(spark, sf), ["clip_id"], "h", "event_id", "value", 6)


TICKS = f"""WITH RECURSIVE {HOURS},
s AS (SELECT clip_id, event_id, row_number() OVER w - 1 AS i, floor((h - first_value(h) OVER w + 6.0::DOUBLE) / 12.0::DOUBLE)::BIGINT AS u
  FROM hours WINDOW w AS (PARTITION BY clip_id ORDER BY h, event_id)),
r AS (SELECT clip_id, event_id, i, 0::BIGINT AS tick, 1::BIGINT AS kept FROM s WHERE i = 0
  UNION ALL SELECT s.clip_id, s.event_id, s.i, CASE WHEN r.kept <= s.u THEN r.kept END, r.kept + CASE WHEN r.kept <= s.u THEN 1 ELSE 0 END
  FROM r JOIN s ON s.clip_id = r.clip_id AND s.i = r.i + 1)"""


@query("c15_grid_resample", "C15", f"{TICKS} SELECT clip_id, event_id, tick FROM r")
def c15(spark, sf):
    h = hours(spark, sf)
    first = h.groupBy("clip_id").agg(F.min("h").alias("h0"))
    rows = h.join(first, "clip_id").withColumn("since", F.col("h") - F.col("h0"))
    return I.resample(rows, ["clip_id"], ["h", "event_id"], "since", 12.0, event_limit(spark, sf)).select("clip_id", "event_id", "tick")


@query("c15_closed_grid", "C15", f"""{TICKS}, k AS (SELECT clip_id, tick, event_id FROM r WHERE tick < 40), m AS (SELECT clip_id, max(tick) AS t, arg_max(event_id, tick) AS e FROM k GROUP BY 1)
SELECT * FROM k UNION ALL SELECT clip_id, unnest(range(t + 1, 40)), e FROM m""")
def c15_closed(spark, sf):
    """Exactly forty ticks a series: the last row repeats where it is shorter."""
    return I.closed_grid(c15(spark, sf), ["clip_id"], "tick", ["event_id"], LIT(40).cast("long"))


def lengths(s):
    return s.groupBy("clip_id").agg(F.count(LIT(1)).alias("n"))


WINDOWS = f"""n AS (SELECT clip_id, count(*) AS n FROM series GROUP BY 1),
w0 AS (SELECT clip_id, n, CASE WHEN n <= 24 THEN [0::BIGINT] ELSE range(0, n - 24 + 1, 12) END AS s FROM n),
wins AS (SELECT clip_id, n, unnest(CASE WHEN n > 24 AND s[-1] + 24 < n THEN list_append(s, n - 24) ELSE s END) AS start FROM w0)"""


@query("c16_windows_with_tail", "C16", f"WITH {SERIES}, {WINDOWS} SELECT clip_id, start, least(start + 24, n) AS stop FROM wins")
def c16(spark, sf):
    return I.windows(lengths(series(spark, sf)), ["clip_id"], 24, 12)


@query("c17_overlap_average", "C17", f"""WITH {SERIES}, {WINDOWS},
j AS (SELECT s.clip_id, t, start, x * (1 + start / 100.0::DOUBLE) AS v FROM series s JOIN wins w ON w.clip_id = s.clip_id AND t >= start AND t < start + 24),
p AS (SELECT clip_id, t, avg(v) AS score, count(*) AS windows FROM j GROUP BY 1, 2),
v AS (SELECT clip_id, max(m) AS video FROM (SELECT clip_id, start, avg(v) AS m FROM j GROUP BY 1, 2) GROUP BY 1)
SELECT clip_id, t, round(score, 6) AS score, windows, round(video, 6) AS video FROM p JOIN v USING (clip_id)""")
def c17(spark, sf):
    s = series(spark, sf).select("clip_id", "t", "x")
    wins = I.windows(lengths(s), ["clip_id"], 24, 12)
    frames, video = I.overlap_average(s, wins, ["clip_id"], "t", lambda a: F.col("x") * (1 + a / 100.0))
    return frames.join(video, "clip_id").select(
        "clip_id", "t", F.round("score", 6).alias("score"), "windows", F.round("video", 6).alias("video"))


@query("c19_trim_relabel", "C19", f"""WITH {CLIPS}, c AS (SELECT clip_id, ['real','sham','voice','source','donor','both'][(clip_id % 6 + 1)::INT] AS cell,
  status = 'F' AS whole, round_even(duration_s * 25, 0) AS f FROM clips),
d AS (SELECT *, (f - 10) / 25 AS d, f * 0.02::DOUBLE AS a, f * 0.04::DOUBLE - 0.2::DOUBLE AS b FROM c WHERE f > 25)
SELECT clip_id, round(d, 4) AS duration_s, NOT whole AND b > d - 1e-6 AS span_cut,
  CASE WHEN cell IN ('source','donor','both') THEN CASE WHEN whole THEN printf('%.4f-%.4f', 0.0, round(d, 4)) ELSE printf('%.4f-%.4f', round(a, 4), round(b, 4)) END ELSE '' END AS visual FROM d""")
def c19(spark, sf):
    cell = F.element_at(F.array(*[LIT(c) for c in R.CELLS]), (F.col("clip_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("status") == "F", LIT("full")).otherwise(LIT("partial"))
    f = F.bround(F.col("duration_s") * 25, 0)
    rows = clips(spark, sf).select("clip_id", cell.alias("cell"), kind.alias("kind"), f.alias("f")).where("f > 25")
    d, b = (F.col("f") - 10) / 25, F.col("f") * 0.04 - 0.2
    part = F.array(S.span(F.col("f") * 0.02, b))
    labels = R.cell_labels(F.col("cell"), F.col("kind"), d, part)
    return rows.select("clip_id", F.round(d, 4).alias("duration_s"),
                       ((F.col("kind") == "partial") & (b > d - 1e-6)).alias("span_cut"),
                       S.as_text(labels["visual"]).alias("visual"))
