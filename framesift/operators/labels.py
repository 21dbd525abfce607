"""Mismatch labels from sync measurements: 1, 0 or NULL (cannot tell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.rules import LIPSYNC_CELLS, kleene_or
from framesift.functions.spans import total_length
from framesift.operators.joins import composite_lookup
from framesift.operators.signals import _median, exact_quantiles
from framesift.sources.measures import MAX_LAG

# Meters, their curve and the rule's defaults.
METERS = {"avhubert": "cos", "syncnet": "dist"}
RULE = {"near_shift": 1, "negative_quantile": 0.95, "positive_quantile": 0.99, "sharpness_quantile": 0.10, "min_reals": 30}


def _clean(curve: Column) -> Column:
    return F.filter(curve, lambda x: x.isNotNull() & ~F.isnan(x))


def badness(meter: str, curve: Column) -> Column:
    """Higher = worse match: −cos, or the distance as it is."""
    return F.transform(curve, lambda x: -x) if meter == "avhubert" else curve


def sharpness(meter: str, curve: Column) -> Column:
    """Height of the peak over the median (depth of the dip for distances), NaN values left out."""
    known = _clean(curve)
    if meter == "avhubert":
        return F.array_max(known) - _median(known)
    return _median(known) - F.array_min(known)


def at_shift(bad: Column, k: int) -> Column:
    """Badness at lag 0 once the audio is shifted k frames; NULL outside the curve."""
    i = MAX_LAG - k
    value = F.get(bad, F.lit(i)) if i >= 0 else F.lit(None).cast("double")
    return F.when(~F.isnan(value), value)


def thresholds(rows: DataFrame, rules: dict | None = None) -> DataFrame:
    """(meter, reals, negative, positive, sharpness) from the real rows of the train split; too few
    measured rows fail the job."""
    r = {**RULE, **(rules or {})}
    reals = rows.where("split = 'train' AND cell = 'real'")
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("meter"), at_shift(badness(m, F.col(c)), 0).alias("bad"), sharpness(m, F.col(c)).alias("sharp"))
        for m, c in METERS.items()])).alias("x")
    long = reals.select(cells).select("x.*")
    bad = exact_quantiles(long, ["meter"], "bad", {"negative": r["negative_quantile"], "positive": r["positive_quantile"]})
    sharp = exact_quantiles(long, ["meter"], "sharp", {"sharpness": r["sharpness_quantile"]}).drop("n")
    out = bad.withColumnRenamed("n", "reals").join(sharp, "meter")
    enough = F.when(F.col("reals") >= r["min_reals"], F.col("reals")).otherwise(
        F.raise_error(F.lit("too few measured real rows to set thresholds")).cast("long"))
    return out.withColumn("reals", enough)


def with_limits(rows: DataFrame, thr: DataFrame) -> DataFrame:
    """Attach the limits of every meter as columns. They form one row, so broadcasting it is safe."""
    names = ("negative", "positive", "sharpness")
    row = thr.groupBy(F.lit(1).alias("_one")).agg(*[
        F.max(F.when(F.col("meter") == m, F.col(n))).alias(f"{n}_{m}") for m in METERS for n in names])
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one", "left").drop("_one")


def region(rows: DataFrame, thr: DataFrame) -> DataFrame:
    """Add the limits, bad_<meter> and measurable: every meter present and sharp enough. NULL when a
    meter is missing."""
    ok, present = F.lit(True), F.lit(True)
    out = {}
    for m, c in METERS.items():
        out[f"bad_{m}"] = badness(m, F.col(c))
        ok = ok & F.coalesce(sharpness(m, F.col(c)) >= F.col(f"sharpness_{m}"), F.lit(False))
        present = present & F.col(c).isNotNull()
    return with_limits(rows, thr).withColumns({**out, "measurable": F.when(present, ok)})


def measured_state(bads: dict[str, Column], k: int) -> Column:
    """1 when every meter is above its positive limit, 0 when all are at or under the negative one."""
    above, below = F.lit(True), F.lit(True)
    for m, bad in bads.items():
        value = at_shift(bad, k)
        above = above & (value > F.col(f"positive_{m}"))
        below = below & (value <= F.col(f"negative_{m}"))
    return F.when(above, F.lit(1)).when(below, F.lit(0)).cast("long")


def with_regions(rows: DataFrame, thr: DataFrame, sibling: Column) -> DataFrame:
    """Add src (region of the source's real row) and gen (region of the full sibling, `sibling` gives
    its id) as structs."""
    marked = region(rows, thr)
    fields = [*(f"bad_{m}" for m in METERS), "measurable"]
    packed = marked.withColumn("_r", F.when(F.col("measurable").isNotNull(), F.struct(*fields)))
    looked = composite_lookup(packed, ["split", "source_clip_id"], F.col("cell") == "real", {"src": "_r"})
    other = packed.select(F.col("sample_id").alias("_sib"), F.col("_r").alias("gen"))
    return looked.withColumn("_sib", sibling).join(other, "_sib", "left").drop("_sib", "_r", *fields)


def _bads(column: str) -> dict[str, Column]:
    return {m: F.col(column)[f"bad_{m}"] for m in METERS}


def real_state(k: int, mode: str = "measured", near: int = 1) -> Column:
    """State of real lips with real audio shifted k frames: 0 near no shift, else as measured."""
    if abs(k) <= near:
        return F.lit(0).cast("long")
    if mode != "measured":
        return F.lit(None).cast("long")
    return F.when(F.col("src.measurable"), measured_state(_bads("src"), k))


def generated_state(k: int, mode: str = "measured") -> Column:
    """State of generated lips: needs a measurable source, not a sharp curve of its own."""
    if mode != "measured":
        return F.lit(None).cast("long")
    return F.when(F.col("src.measurable") & F.col("gen").isNotNull(), measured_state(_bads("gen"), k))


def video_state(k: int = 0, mode: str = "measured", near: int = 1) -> Column:
    """Label of the whole video at shift k from av_mismatch, visual spans, cell and duration_s."""
    given = F.size("av_mismatch") > 0
    if mode == "construction":
        return given.cast("long")
    made = F.col("cell").isin(LIPSYNC_CELLS) & (F.size("visual") > 0)
    whole = made & (total_length(F.col("visual")) >= F.col("duration_s") - 0.04)
    gen, real = generated_state(k, mode), real_state(k, mode, near)
    state = F.when(made & ~whole, kleene_or(gen, real)).when(whole, kleene_or(gen)).otherwise(kleene_or(real))
    return F.when(given, F.lit(1)).otherwise(state).cast("long")


def frame_state(made: Column, content: Column, real: Column, gen: Column) -> tuple[Column, Column]:
    """(value, valid) of a frame: measured state of its region unless known content covers it."""
    state = F.when(made, gen).otherwise(real)
    value = F.coalesce(state, F.lit(0)).cast("double")
    return (F.when(content > 0, F.greatest(value, content)).otherwise(value),
            (content > 0) | state.isNotNull())


def mismatch_spans(made: Column, state: Column, given: Column, visual: Column) -> Column:
    """Spans labelled 1: those made on purpose plus generated lips judged 1; NULL when unknown."""
    return (F.when(~made, given).when(state.isNull(), F.lit(None)).when(state == 1, F.concat(given, visual)).otherwise(given))
