"""Values the rules must reproduce, on hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions import rules as R
from framesift.functions import spans as S
from framesift.functions.text import clean_words, edit_words
from framesift.operators import allocate as A
from framesift.operators import intervals as I
from framesift.operators import metrics as M
from framesift.operators import signals as G

LIT = F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pauses_and_regions(spark, rows):
    """600 steps of speech with two quiet dips inside."""
    quiet = {*range(186, 188), *range(342, 344)}
    data = [("v", i, 0.1 if i in quiet else 0.9) for i in range(600)]
    s = spark.createDataFrame(data, "k string, t long, p double")
    d = spark.createDataFrame([("v", 19.2)], "k string, duration double")
    regions = I.speech_regions(s, ["k"], "t", F.col("p") >= 0.5, d)
    assert [tuple(round(x, 3) for x in r[1:]) for r in rows(regions)] == [(0.0, 19.2)]
    pauses = I.pauses_inside(s, regions, ["k"], "t", F.col("p") < 0.5)
    mids = sorted((a + b) / 2 for _, a, b in rows(pauses))
    assert [round(m, 2) for m in mids] == [5.98, 10.98]


def plan(spark, speech, pauses, scenes=(), duration=60.0):
    f = spark.createDataFrame
    out = I.plan_clips(
        f([("v", float(a), float(b)) for a, b in speech], "k string, a double, b double"),
        f([("v", float(t)) for t in scenes], "k string, t double"),
        f([("v", float(m), float(n)) for m, n in pauses], "k string, mid double, length double"),
        f([("v", duration)], "k string, duration double"), "k")
    return sorted((r["a"], r["b"]) for r in out.collect())


def test_plan_clips_cuts_at_pauses(spark):
    assert plan(spark, [(0, 16)], [(6.0, 0.1), (11.0, 0.1)])[0] == (0.0, 6.0)
    assert plan(spark, [(0, 16)], [])[0] == (0.0, 7.0)
    assert plan(spark, [(0, 3.9)], []) == []
    assert plan(spark, [(0, 7.5)], []) == [(0.0, 7.0)]
    assert plan(spark, [(0, 12)], [], scenes=[5.0]) == [(0.0, 5.0), (5.0, 12.0)]


def test_single_target_and_quota(spark):
    for seconds, want in ((60, 30), (750, 40), (3600, 50)):
        assert one(spark, A.single_target(LIT(float(seconds)), 30, 50, 5, 20)) == want
    df = spark.createDataFrame([("a", 1, 10, 1.0), ("a", 2, 10, 1.0), ("a", 3, 10, 2.0)], "k string, i long, total long, w double")
    got = sorted((r["i"], r["quota"]) for r in A.split_quota(df, ["k"], "i", "total", "w").collect())
    assert sum(q for _, q in got) == 10 and dict(got)[3] == 5


def test_spread_order_and_take(spark):
    wins = [("v", float(a), float(a + 5), a < 50) for a in range(0, 100, 5)]
    df = spark.createDataFrame(wins, "k string, a double, b double, ok boolean")
    placed = A.spread_order(df, ["k"], "a", "b", LIT(4), LIT(100.0))
    first = placed.where("bucket = 0 AND turn = 0").first()
    assert (first["a"], first["b"]) == (10.0, 15.0)
    tried = A.take_spread(placed.withColumn("quota", LIT(4)).withColumn("budget", LIT(8)), ["k"], "ok", "quota", "budget")
    opened = [(r["a"], r["ok"]) for r in tried.where("tried").collect()]
    assert len(opened) <= 8 and sum(ok for _, ok in opened) <= 4 and (10.0, True) in opened


def test_curve_minimum(spark):
    curve = [14.0] * 31
    curve[17] = 8.0
    df = spark.createDataFrame([(curve,)], "c array<double>")
    lag, conf = G.curve_stats(F.col("c"), lowest=True)
    assert tuple(df.select(lag, conf).first()) == (2, 6.0)


def test_sync_summary_states(spark):
    def curve(at):
        c = [14.0] * 31
        c[at + 15] = 8.0
        return c

    data = [("ok", curve(2)) for _ in range(5)] + [("few", curve(2)) for _ in range(2)]
    data += [("bad", curve(i)) for i in (-9, -3, 4, 8, 12)]
    df = spark.createDataFrame(data, "v string, c array<double>")
    got = {r["v"]: (r["status"], r["lag"]) for r in G.summarize_curves(df, "v", "c", 3, 3.0, 0.8).collect()}
    assert got["ok"] == ("ok", 2) and got["few"] == ("few", 2) and got["bad"][0] == "unreliable"


def test_union_and_targets(spark):
    spans = F.array(S.span(LIT(2.0), LIT(3.0)), S.span(LIT(0.0), LIT(1.0)), S.span(LIT(1.0), LIT(1.5)))
    assert [tuple(s) for s in one(spark, S.union(spans))] == [(0.0, 1.5), (2.0, 3.0)]
    clips = spark.createDataFrame([(1, 4.0, True), (2, 4.0, False)], "clip_id long, duration double, known boolean")
    marks = spark.createDataFrame([(1, 0.05, 0.1)], "clip_id long, a double, b double")
    cells = {(r["clip_id"], r["cell"]): r["target"] for r in I.cell_cover(clips, marks, 0.2).collect()}
    assert cells[(1, 0)] == pytest.approx(0.25) and cells[(1, 1)] == 0.0 and cells[(2, 5)] == -1.0


def test_perfect_proposals(spark):
    scores = [("s", i, 5.0 if 25 <= i < 50 else -5.0) for i in range(125)] + [("r", i, -5.0) for i in range(125)]
    s = spark.createDataFrame(scores, "clip string, t long, x double")
    truth = spark.createDataFrame([("s", 1.0, 2.0)], "clip string, a double, b double")
    found = G.proposals(s.where("clip = 's'"), ["clip"], "t", "x")
    got = {r["metric"]: r["value"] for r in M.temporal_scores(M.match_segments(found, truth, "clip"), "clip").collect()}
    assert got["ap@50"] == got["ap@95"] == got["ar@1"] == pytest.approx(1.0)


def test_speaker_weights(spark):
    s = spark.createDataFrame([("t", "a", i) for i in range(3)] + [("t", "b", 9)], "split string, sp string, clip long")
    got = {r["sp"]: r["weight"] for r in A.sampling_weights(s, ["split", "sp"], "clip").collect()}
    assert got["a"] * 3 == pytest.approx(got["b"])
    even = A.sampling_weights(s.where("sp = 'b'"), ["split", "sp"], "clip").first()["weight"]
    assert even is None


def test_jump_is_found_turn_is_not(spark):
    def track(jump):
        out = []
        for t in range(100):
            motion = 0.5 if jump and t == 50 else 0.004
            out.append(("j" if jump else "s", t, motion, 9.0 if jump and t == 50 else 0.0, 0.0))
        return out

    s = spark.createDataFrame(track(True) + track(False), "k string, t long, motion double, app_z double, audio_z double")
    assert [tuple(r) for r in G.detect_jumps(s, ["k"], "t").collect()] == [("j", 50, "confident")]


def test_identity_list_and_labels(spark):
    assert one(spark, A.identity_list(LIT("b; a;unknown;;NaN;a"))) == ["a", "b"]
    states = {(None, 1): 1, (None, 0): None, (0, 0): 0}
    for (a, b), want in states.items():
        assert one(spark, R.kleene_or(LIT(a).cast("long"), LIT(b).cast("long"))) == want


def test_swap_prefers_longest(spark):
    words = clean_words(LIT("Tôi đồng ý, có 3 người."))
    got = one(spark, edit_words(words, LIT(1), "s"))
    assert got["kind"] == "swap:đồng ý->phản đối" and "phản đối" in got["text"]
    assert one(spark, edit_words(clean_words(LIT("x 12 y")), LIT(1), "s"))["kind"] == "number"
    assert one(spark, edit_words(clean_words(LIT("x y")), LIT(1), "s"))["text"] is None


def test_url_classes(spark):
    cases = {
        "https://www.youtube.com/watch?v=abcdefghijk&t=1": ("video", "https://www.youtube.com/watch?v=abcdefghijk"),
        "https://youtu.be/abcdefghijk": ("video", "https://www.youtube.com/watch?v=abcdefghijk"),
        "https://www.youtube.com/@name": ("channel", "https://www.youtube.com/@name/videos"),
        "https://www.youtube.com/playlist?list=PL1": ("playlist", "https://www.youtube.com/playlist?list=PL1"),
        "https://example.com/watch?v=abcdefghijk": (None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in df.select("u", R.classify_url(F.col("u")).alias("c")).collect():
        assert tuple(r["c"]) == cases[r["u"]]


def test_bootstrap_equals_direct_computation(spark):
    rnd = np.random.default_rng(3)
    data = [(int(rnd.integers(8)), int(rnd.integers(2)), float(rnd.integers(20)), float(rnd.integers(20))) for _ in range(300)]
    df = spark.createDataFrame(data, "sp long, y int, a double, b double")
    weights = {r["sp"]: r["w"] for r in M.bootstrap_weights(df, "sp", 40, 42).collect()}
    assert all(sum(w[i] for w in weights.values()) == 8 for i in range(40))

    def auc(scores, w):
        num = den = 0.0
        for i, (_, y1, *_r) in enumerate(data):
            if y1:
                for j, (_, y2, *_q) in enumerate(data):
                    if not y2:
                        num += w[i] * w[j] * ((scores[i] > scores[j]) + 0.5 * (scores[i] == scores[j]))
                        den += w[i] * w[j]
        return num / den

    a, b = [d[2] for d in data], [d[3] for d in data]
    deltas = []
    for r in range(40):
        w = [weights[d[0]][r] for d in data]
        deltas.append(auc(a, w) - auc(b, w))
    for rows_per_slice in (7, 5_000):
        got = M.paired_bootstrap(df, "sp", "y", "a", "b", 40, 42, slice_rows=rows_per_slice).first()
        assert got["delta"] == pytest.approx(auc(a, [1] * 300) - auc(b, [1] * 300))
        assert [got["lo"], got["hi"]] == pytest.approx(list(np.quantile(deltas, [0.025, 0.975])))
