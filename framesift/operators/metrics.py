"""Detector metrics. Every ranking metric starts from counts per distinct score, so ties collapse
before the shuffle, and reads running counts in score order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framesift.functions.hashing import stable_int
from framesift.operators.joins import spread_join
from framesift.operators.ordered import HOT_ROWS, positions, previous, python_groups, running, settle
from framesift.operators.signals import exact_quantiles
from framesift.session import checkpointed

# False-alarm targets, fake rates, IoU levels and list lengths of the reports.
FPR_TARGETS = {"fpr_0.01": 0.99, "fpr_0.05": 0.95}
BASE_RATES = [0.5, 0.1, 0.01]
IOU_AP = [0.5, 0.75, 0.95]
IOU_AR = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
AR_AT = [1, 5, 10]


def score_table(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(keys, score, pos, neg): weight of positives and negatives per distinct score; rows with an
    unknown label or score are left out."""
    w = F.lit(1.0) if weight is None else weight
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return known.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))


def auc(df: DataFrame, keys: list[str], score: str, label: str, weight: Column | None = None,
        name: str = "auc", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, n, name): tie-corrected (weighted) AUC; NULL unless both classes occur.
    n = weight of all rows."""
    table = score_table(df, keys, score, label, weight)
    ranked = running(table, keys, [score], {"_below": ("sum", F.col("neg"))}, hot_rows=hot_rows)
    wins = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    value = F.when((F.max(F.col("pos")) > 0) & (F.max(F.col("neg")) > 0), wins / (p * n))
    return ranked.groupBy(*keys).agg((p + n).alias("n"), value.alias(name))


def speaker_weight(df: DataFrame, keys: list[str], speaker: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add `weight` = 1 / rows of the speaker (within keys)."""
    n = df.groupBy(*keys, speaker).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return spread_join(df, n, [*keys, speaker], "inner", hot_rows=hot_rows)


def roc(df: DataFrame, keys: list[str], score: str, label: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, p, n): running counts from the highest score down, plus the
    totals of the key."""
    table = score_table(df, keys, score, label)
    hot_rows = settle(table, keys, hot_rows)
    falling = running(table, keys, [f"-{score}"], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, hot_rows=hot_rows)
    totals = table.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return spread_join(falling, totals, keys, "inner", [score], hot_rows)


def eer(df: DataFrame, keys: list[str], score: str, label: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Equal error rate at the kept ROC point of least |fpr − fnr|. The curve starts at (0, 0) and
    drops points in the middle of a straight line; NULL unless both classes occur."""
    curve = roc(df, keys, score, label, hot_rows)
    lower = previous(curve, keys, [score], {"_pos": "pos", "_neg": "neg"}, hot_rows)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bends = (F.col("_pos") != F.col("pos")) | (F.col("_neg") != F.col("neg"))
    kept = lower.where(first | F.col("_pos").isNull() | bends)
    fpr, tpr = F.try_divide("fp", "n"), F.try_divide("tp", "p")
    best = F.min(F.struct(F.abs(fpr - (1 - tpr)).alias("d"), (-F.col(score)).alias("s"), ((fpr + 1 - tpr) / 2).alias("eer")))
    out = kept.groupBy(*keys).agg(best.alias("_b"), F.max("p").alias("_p"), F.max("n").alias("_n"))
    value = F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                   F.when(F.col("_b.d") < 1, F.col("_b.eer")).otherwise(F.lit(0.5)))
    return out.select(*keys, value.alias("eer"))


def best_threshold(df: DataFrame, keys: list[str], score: str, label: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Threshold of the largest F1 over distinct scores, the higher one on a tie."""
    curve = roc(df, keys, score, label, hot_rows)
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1.0), F.col("tp") + F.col("p") + F.col("fp"))
    top = F.max(F.struct(f1.alias("f1"), F.col(score).alias("t")))
    return curve.groupBy(*keys).agg(top["t"].alias("threshold"), top["f1"].alias("f1"))


def at_threshold(df: DataFrame, keys: list[str], score: str, label: str, threshold: str) -> DataFrame:
    """F1, false-alarm rate and recall of score ≥ threshold (a column of the rows)."""
    hit, y = F.col(score) >= F.col(threshold), F.col(label)
    c = {"tp": hit & (y == 1), "fp": hit & (y == 0), "fn": ~hit & (y == 1), "neg": y == 0, "pos": y == 1}
    sums = df.groupBy(*keys).agg(*[F.count(F.when(cond, 1)).alias(n) for n, cond in c.items()])

    def ratio(top, bottom):
        return top / F.greatest(F.lit(1), bottom)

    tp = F.col("tp")
    return sums.select(*keys, ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
                       ratio(F.col("fp"), F.col("neg")).alias("far"), ratio(tp, F.col("pos")).alias("recall"))


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Σ recall step × precision over distinct scores; NULL without positives."""
    curve = roc(df, keys, score, label, hot_rows)
    ap = F.sum(F.try_divide("pos", "p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.groupBy(*keys).agg(F.when(F.max("p") > 0, ap).alias("ap"))


def alarm_thresholds(real_scores: DataFrame, keys: list[str], score: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, point, threshold): quantiles of the scores of real rows, one per false-alarm target."""
    q = exact_quantiles(real_scores, keys, score, {f"q{i}": p for i, p in enumerate(FPR_TARGETS.values())}, hot_rows)
    points = F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(f"q{i}").alias("threshold"))
                                 for i, n in enumerate(FPR_TARGETS)])).alias("x")
    return q.select(*keys, points).select(*keys, "x.*")


def within_groups(df: DataFrame, keys: list[str], group: str, prefix: str, score: str, label: str,
                  hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, group, n, auc): positives and negatives of the same group only; n counts the positives. Rows
    without a group take no part."""
    rows = df.where(F.col(group).isNotNull() & (F.col(group).cast("string") != "")).select(
        *keys, F.concat(F.lit(prefix), F.col(group).cast("string")).alias("group"), score, label)
    n = rows.groupBy(*keys, "group").agg(F.sum((F.col(label) == 1).cast("long")).alias("n"))
    return n.join(auc(rows, [*keys, "group"], score, label, hot_rows=hot_rows).drop("n"), [*keys, "group"], "left")


def operating_points(validation: DataFrame, test: DataFrame, keys: list[str], score: str, label: str,
                     hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """TPR / FPR of score > threshold on the test rows and precision at three fake rates."""
    cuts = alarm_thresholds(validation.where(F.col(label) == 0), keys, score, hot_rows)
    rows = spread_join(test, cuts, keys, "inner", hot_rows=hot_rows)
    hit, y = (F.col(score) > F.col("threshold")).cast("double"), F.col(label)
    rates = rows.groupBy(*keys, "point", "threshold").agg(
        F.avg(F.when(y == 1, hit)).alias("tpr"), F.avg(F.when(y == 0, hit)).alias("fpr"))
    rates = rates.where("tpr IS NOT NULL AND fpr IS NOT NULL")
    rate = F.explode(F.array(*[F.lit(r) for r in BASE_RATES])).alias("rate")
    both = rates.select("*", rate)
    top = F.col("tpr") * F.col("rate")
    return both.withColumn("precision", top / F.greatest(F.lit(1e-12), top + F.col("fpr") * (1 - F.col("rate"))))


def versus_reals(df: DataFrame, keys: list[str], score: str, positive: Column, real: Column, groups: Column,
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, group, n, auc): positives of each group against all real rows of the key.

    The reals are counted once in score order; every positive then knows how many of them it beats,
    whichever groups it is in. `groups` is the array of group names of a row.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    reals = rows.where(real).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_real"))
    mine = rows.where(positive).select(*keys, score, F.explode(groups).alias("group"))
    mine = mine.groupBy(*keys, score, "group").agg(F.count(F.lit(1)).alias("_k"))
    marks = reals.unionByName(mine.select(*keys, score, F.lit(0).cast("long").alias("_real")))
    marks = marks.groupBy(*keys, score).agg(F.sum("_real").alias("_real"))
    ranked = running(marks, keys, [score], {"_upto": ("sum", F.col("_real"))}, hot_rows=hot_rows)
    beaten = ranked.select(*keys, score, (F.col("_upto") - F.col("_real") / 2).alias("_wins"))
    total = reals.groupBy(*keys).agg(F.sum("_real").alias("_n"))
    joined = mine.join(beaten, [*keys, score]).join(total, keys, "left")
    return joined.groupBy(*keys, "group").agg(
        F.sum("_k").alias("n"), (F.sum(F.col("_k") * F.col("_wins")) / (F.sum("_k") * F.max("_n"))).alias("auc"))


def per_speaker(df: DataFrame, keys: list[str], speaker: str, score: str, label: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean and least AUC within a speaker; one-class speakers are left out."""
    own = auc(df, [*keys, speaker], score, label, hot_rows=hot_rows)
    return own.where("auc IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("speakers"), F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"))


def first_references(df: DataFrame, group: list[str], ident: str, real: Column, count: int) -> DataFrame:
    """The first `count` real rows per group by id, as (group, rank 1…count)."""
    w = W.partitionBy(*group).orderBy(ident)
    return df.where(real).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def reference_norm(df: DataFrame, group: list[str], ident: str, source: str, score: str, label: str, real: Column,
                   count: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """AUC raw and after a z-score by the group's reference rows, on the same rows: references and
    everything derived from their sources are left out."""
    refs = first_references(df, group, ident, real, count)
    stats = refs.groupBy(*group).agg(F.avg(score).alias("_m"), (F.stddev_pop(score) + 1e-3).alias("_s"))
    kept = spread_join(df.join(refs.select(source).distinct(), source, "left_anti"), stats, group, "inner", [ident], hot_rows)
    kept = kept.withColumn("_norm", (F.col(score) - F.col("_m")) / F.col("_s")).withColumn("_all", F.lit(0))
    raw = auc(kept, ["_all"], score, label, name="auc_raw", hot_rows=hot_rows)
    norm = auc(kept, ["_all"], "_norm", label, name="auc_norm", hot_rows=hot_rows).drop("n")
    return raw.join(norm, "_all").drop("_all")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, recall of the truth class, overall accuracy)."""
    cells = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(truth)  # one row per class pair, not per sample
    total = cells.agg(F.sum("n")).scalar()
    hits = cells.where(F.col(truth) == F.col(guess)).agg(F.sum("n")).scalar()
    right = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).over(w)
    return cells.select(truth, guess, "n", (right / F.sum("n").over(w)).alias("recall"), (hits / total).alias("accuracy"))


def frame_localization(frames: DataFrame, keys: list[str], pos: str, score: str, truth: str, edge: int = 2,
                       hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per clip with both kinds of frames: AUC inside vs outside, whether the top frame (first on a
    tie) is inside, mean score near the first / last true frame and in the middle."""
    t, inside = F.col(pos), F.col(truth) == 1
    area = auc(frames, keys, score, truth, hot_rows=hot_rows).where("auc IS NOT NULL").select(*keys, "auc")
    ends = frames.groupBy(*keys).agg(
        F.min(F.when(inside, t)).alias("_lo"), F.max(F.when(inside, t)).alias("_hi"),
        F.max(F.struct(F.col(score), (-t).alias("neg"), F.col(truth).alias("y")))["y"].alias("top_inside"))
    near = (F.abs(t - F.col("_lo")) <= edge) | (F.abs(t - F.col("_hi")) <= edge)
    marks = spread_join(frames, ends, keys, "inner", [pos], hot_rows).where(inside).groupBy(*keys).agg(
        F.avg(F.when(near, F.col(score))).alias("edge"), F.avg(F.when(~near, F.col(score))).alias("middle"))
    return area.join(ends.select(*keys, "top_inside"), keys).join(marks, keys)


def match_segments(found: DataFrame, truth: DataFrame, clip: str) -> DataFrame:
    """Greedy one-to-one matching per clip: found(clip, score, a, b), truth(clip, a, b) → one row per
    found segment with hit_<iou> for the AP levels and, for the AR levels, the truths reached by the
    first N segments. A clip has at most the kept proposals and its few labelled spans."""
    segs = found.select(clip, "score", "a", "b", F.lit(0).alias("is_truth")).unionByName(
        truth.select(clip, F.lit(None).cast("double").alias("score"), "a", "b", F.lit(1).alias("is_truth")))
    kind = dict(found.dtypes)[clip]
    hits = [f"hit_{round(v * 100)}" for v in IOU_AP]
    schema = f"{clip} {kind}, score double, a double, b double, truths long, " + ", ".join(
        [f"{h} int" for h in hits] + [f"ar_{n} double" for n in AR_AT])

    def match(rows: pa.Table) -> pa.Table:
        truth, (score, a, b) = rows["is_truth"].to_numpy() == 1, (rows[c].to_numpy() for c in ("score", "a", "b"))
        spans, at = np.flatnonzero(truth), np.flatnonzero(~truth)
        at = at[np.lexsort((b[at], a[at], -score[at]))]
        inter = np.clip(np.minimum(b[at][:, None], b[spans]) - np.maximum(a[at][:, None], a[spans]), 0, None)
        hull = np.maximum(b[at][:, None], b[spans]) - np.minimum(a[at][:, None], a[spans])
        cover = inter / np.where(hull > 0, hull, 1)
        size = max(len(at), 1)
        some = rows.select([clip, "score", "a", "b"]).take(pa.array(at if len(at) else [0]))
        if not len(at):
            some = pa.table({clip: some[clip], **{c: pa.nulls(1, pa.float64()) for c in ("score", "a", "b")}})
        out = {"truths": np.full(size, len(spans), np.int64)}
        for level, name in zip(IOU_AP, hits):
            free, flags = np.ones(len(spans), bool), np.zeros(size, np.int32)
            for i in np.flatnonzero((cover >= level).any(1)) if len(spans) else ():
                open_ = np.where(free & (cover[i] >= level), cover[i], -1.0)
                j = len(open_) - 1 - int(np.argmax(open_[::-1]))  # the last best span wins a tie
                if open_[j] >= level:
                    free[j], flags[i] = False, 1
            out[name] = flags
        for n in AR_AT:
            best = cover[:n].max(axis=0) if len(at) and len(spans) else np.zeros(len(spans))
            reached = np.zeros(size)
            reached[0] = float(np.mean([(best >= v).sum() for v in IOU_AR])) if len(spans) else 0.0
            out[f"ar_{n}"] = reached
        return pa.table({**{c: some[c] for c in some.column_names}, **out})

    return python_groups(segs, [clip]).applyInArrow(match, schema)


def temporal_scores(matched: DataFrame, clip: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(metric, value): AP at the IoU levels with the falling precision envelope, and AR@N.

    Segments of all clips are ranked together in two ordered passes: precision from the top, its
    running maximum from the bottom. The matched rows (a few per clip) are written once, because the
    totals, both passes and the recall read them.
    """
    matched = checkpointed(matched)
    total = matched.groupBy(clip).agg(F.max("truths").alias("k")).agg(F.sum("k")).scalar()
    rows = matched.where("score IS NOT NULL").withColumn("_all", F.lit(0))
    hot_rows = settle(rows, ["_all"], hot_rows)
    placed = positions(rows, ["_all"], ["-score", clip, "a"], "_r", hot_rows)
    hits = {c: c for c in matched.columns if c.startswith("hit_")}
    upto = running(placed, ["_all"], ["_r"], {f"_{h}": ("sum", F.col(h)) for h in hits}, hot_rows=hot_rows)
    upto = upto.withColumns({f"_p{h}": F.col(f"_{h}") / (F.col("_r") + 1) for h in hits}).withColumn("_back", -F.col("_r"))
    env = running(upto, ["_all"], ["_back"], {f"_e{h}": ("max", F.col(f"_p{h}")) for h in hits}, hot_rows=hot_rows)
    # No proposals at all, but segments to find: 0.
    ap = env.agg(*[F.try_divide(F.coalesce(F.sum(F.col(h) * F.col(f"_e{h}")), F.lit(0.0)), total).alias(h.replace("hit_", "ap@")) for h in hits])
    ar = matched.agg(*[F.try_divide(F.sum(f"ar_{n}"), F.max(total)).alias(f"ar@{n}") for n in AR_AT])

    def long(df):
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in df.columns]))
        return df.select(cells.alias("m")).select("m.*")

    return long(ap).unionByName(long(ar))


def zscore_fusion(validation: DataFrame, test: DataFrame, real: Column, ident: str, members: dict[str, str]) -> DataFrame:
    """Scores of two members on one scale (mean / deviation + 1e-6 of the real validation rows) and
    ai = the larger of them."""
    stats = validation.where(real).agg(*[
        f for n, c in members.items() for f in (F.avg(c).alias(f"_m_{n}"), (F.stddev_pop(c) + 1e-6).alias(f"_s_{n}"))])
    z = {}
    for n, c in members.items():
        mean, dev = stats.select(f"_m_{n}").scalar(), stats.select(f"_s_{n}").scalar()
        z[n] = (F.col(c) - F.coalesce(mean, F.lit(0.0))) / F.coalesce(dev, F.lit(1.0))
    out = test.withColumns({f"z_{n}": c for n, c in z.items()})
    return out.withColumn("z_ai", F.greatest(*[F.col(f"z_{n}") for n in members]))


def bootstrap_weights(speakers: DataFrame, speaker: str, replicates: int, seed: int) -> DataFrame:
    """(speaker, w): how often each replicate draws the speaker, as an array of `replicates` counts.

    Draw j of replicate r is a hash, so the table does not depend on partitioning. It has
    speakers × replicates entries, whatever the number of rows.
    """
    listed = positions(speakers.select(speaker).distinct().withColumn("_all", F.lit(0)), ["_all"], [speaker], "_i")
    total = listed.agg(F.count(F.lit(1))).scalar()
    draws = listed.select(F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    pick = stable_int(F.concat_ws(":", F.lit(seed), "_r", "_j")) % total
    counts = draws.groupBy(pick.alias("_i"), "_r").agg(F.count(F.lit(1)).alias("_k"))
    pairs = counts.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_k"))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(replicates - 1))
    w = F.transform(every, lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)).cast("int"))
    empty = F.transform(every, lambda _: F.lit(0))
    return listed.join(pairs, "_i", "left").select(speaker, F.coalesce(w, empty).alias("w"))


def paired_bootstrap(df: DataFrame, speaker: str, label: str, first: str, second: str, replicates: int = 1000,
                     seed: int = 42, slice_rows: int = 5_000, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row: ΔAUC of two score columns, its 95 % interval over speaker resamples (NULL under five
    speakers), speakers and samples.

    Rows are sorted once into slices of neighbouring scores. A task adds up, for all replicates at
    once, the weights and the wins inside its slice; slices are then chained per replicate with one
    running sum. No task sees all rows and no row is copied per replicate.
    """
    known = df.where(F.col(label).isNotNull() & ~F.isnan(first) & ~F.isnan(second) & F.col(first).isNotNull() & F.col(second).isNotNull())
    long = known.select(speaker, F.col(label).alias("y"), F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col(first).cast("double").alias("s")),
        F.struct(F.lit("b").alias("side"), F.col(second).cast("double").alias("s")))).alias("x"))
    cells = long.groupBy("x.side", "x.s", speaker).agg(
        F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    sizes = cells.groupBy("side", "s").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(sizes, ["side"], ["s"], {"_upto": ("sum", F.col("_n"))}, hot_rows=hot_rows)
    placed = placed.select("side", "s", F.floor((F.col("_upto") - F.col("_n")) / slice_rows).alias("slice"))
    weights = bootstrap_weights(known, speaker, replicates, seed)
    rows = cells.join(placed, ["side", "s"]).select("side", "slice", "s", F.col(speaker).alias("_sp"), "pos", "neg")
    # A slice gets the weights of its speakers once, not once per row.
    drawn = rows.select("side", "slice", "_sp").distinct().join(weights.withColumnRenamed(speaker, "_sp"), "_sp").select(
        F.col("side").alias("_side"), F.col("slice").alias("_slice"), F.col("_sp").alias("_who"), "w")

    def inside(pdf: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        table = np.stack(draws["w"].to_numpy()).astype(np.float64)
        place = pd.Series(np.arange(len(draws)), index=draws["_who"])
        w = table[place.loc[pdf["_sp"]].to_numpy()]
        w = np.concatenate([np.ones((len(pdf), 1)), w], axis=1)  # replicate −1: every speaker once
        starts = np.flatnonzero(np.r_[True, np.diff(pdf["s"].to_numpy()) != 0])
        pos = np.add.reduceat(w * pdf["pos"].to_numpy()[:, None], starts, axis=0)
        neg = np.add.reduceat(w * pdf["neg"].to_numpy()[:, None], starts, axis=0)
        wins = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame({
            "side": pdf["side"].iloc[0], "slice": pdf["slice"].iloc[0], "r": np.arange(-1, w.shape[1] - 1),
            "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "wins": wins})

    parts = rows.groupBy("side", "slice").cogroup(drawn.groupBy("_side", "_slice")).applyInPandas(
        inside, "side string, slice long, r int, pos double, neg double, wins double")
    w = W.partitionBy("side", "r").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    chained = parts.withColumn("_below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    value = F.try_divide(F.sum(F.col("wins") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg"))
    areas = chained.groupBy("r").pivot("side", ["a", "b"]).agg(value)
    delta = areas.select("r", (F.col("a") - F.col("b")).alias("d"))
    sizes = known.agg(F.count_distinct(speaker).alias("speakers"), F.count(F.lit(1)).alias("samples"))
    ok = F.when((F.col("r") >= 0) & ~F.isnan("d"), F.col("d"))
    out = delta.agg(F.max(F.when(F.col("r") == -1, F.col("d"))).alias("delta"),
                    F.percentile(ok, 0.025).alias("lo"), F.percentile(ok, 0.975).alias("hi"))
    enough = sizes.select("speakers").scalar() >= 5
    return out.select("delta", F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"),
                      sizes.select("speakers").scalar().alias("speakers"), sizes.select("samples").scalar().alias("samples"))


def histogram(df: DataFrame, keys: list[str], score: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(keys, bin 0…bins+1, n); bins 0 and bins+1 hold what falls outside."""
    b = F.width_bucket(F.col(score).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins))
    return df.groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def roc_points(df: DataFrame, keys: list[str], score: str, label: str, points: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """ROC thinned to about `points` rows: every (size // points)-th row from the highest score."""
    curve = roc(df, keys, score, label, hot_rows)
    placed = positions(curve, keys, [f"-{score}"], "_i", hot_rows)
    size = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_m") / points))
    thin = spread_join(placed, size, keys, "inner", ["_i"], hot_rows).where(F.col("_i") % step == 0)
    return thin.select(*keys, score, F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def gate_table(scores: DataFrame, rows: DataFrame, speaker: str, gates: list[tuple], subset, replicates: int = 1000, seed: int = 42) -> DataFrame | None:
    """(first, second, task, note, subset, variant, delta, lo, hi, speakers, samples): one row per gate.

    scores(model, seed, task, variant, sample_id, score) holds the runs, a null variant the plain test set;
    `rows` holds sample_id, the speaker and a label column per task. A gate (first, second, task, note, subset,
    variant) compares the two models' runs of the smallest seed; it is left out when a model has no run for the
    task and variant. `subset(rows, task, name)` picks the rows of a named subset. The list of runs is a
    planning table and is read to the driver; None when no gate can be judged.
    """
    runs = {(r["model"], r["task"], r["variant"]) for r in scores.select("model", "task", "variant").distinct().collect()}
    first_seed = {r["model"]: r["seed"] for r in scores.groupBy("model").agg(F.min("seed").alias("seed")).collect()}

    def run_of(model, task, variant, name):
        mine = scores.where((F.col("model") == model) & (F.col("seed") == first_seed[model]) & (F.col("task") == task) & F.col("variant").eqNullSafe(F.lit(variant)))
        return mine.select("sample_id", F.col("score").alias(name))

    out = None
    for first, second, task, note, name, variant in gates:
        if not {(first, task, variant), (second, task, variant)} <= runs:
            continue
        picked = subset(rows, task, name) if name else rows
        both = picked.join(run_of(first, task, variant, "_a"), "sample_id").join(run_of(second, task, variant, "_b"), "sample_id")
        one = paired_bootstrap(both, speaker, task, "_a", "_b", replicates, seed).select(
            F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(task).alias("task"), F.lit(note).alias("note"),
            F.lit(name).cast("string").alias("subset"), F.lit(variant).cast("string").alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def over_seeds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over seeds as numbers and as text "m ± s" ("-" without values)."""
    out = df.groupBy(*keys).agg(F.count(value).alias("k"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    text = (F.when(F.col("k") == 0, F.lit("-")).when(F.col("k") == 1, F.format_string("%.3f", "mean"))
            .otherwise(F.format_string("%.3f ± %.3f", "mean", "std")))
    return out.withColumn("text", text)
