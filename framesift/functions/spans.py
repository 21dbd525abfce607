"""Scalar rules over a small array of spans held in one row: array<struct<a: double, b: double>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<a:double,b:double>>"


def span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def unknown_spans() -> Column:
    return F.lit(None).cast(SPANS)


def total_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0).cast("double"), lambda acc, s: acc + (s["b"] - s["a"]))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    hull = F.greatest(b, d) - F.least(a, c)
    return F.when(hull > 0, overlap(a, b, c, d) / hull).otherwise(F.lit(0.0))


def union(spans: Column, tolerance: float = 1e-9) -> Column:
    """Merge the spans of one row, rounded to 4 digits."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(span(last["a"], F.greatest(last["b"], s["b"]))),
        )
        apart = F.concat(acc, F.array(span(s["a"], s["b"])))
        touching = (F.size(acc) > 0) & (s["a"] <= F.try_element_at(acc, F.lit(-1))["b"] + tolerance)
        return F.when(touching, joined).otherwise(apart)

    merged = F.aggregate(F.array_sort(spans), no_spans(), step)
    return F.transform(merged, lambda s: span(F.round(s["a"], 4), F.round(s["b"], 4)))


def ordered_inside(spans: Column, duration: Column) -> Column:
    """True when spans are finite, sorted, disjoint and inside [0, duration]; NULL list passes."""
    last = F.transform(
        spans,
        lambda s, i: F.when(i == 0, F.lit(0.0)).otherwise(F.get(spans, i - 1)["b"]),
    )
    good = F.zip_with(
        spans,
        last,
        lambda s, end: (s["a"] >= 0)
        & (s["a"] < s["b"])
        & (s["b"] <= duration + 1e-6)
        & (s["a"] >= end)
        & ~F.isnan(s["a"])
        & ~F.isnan(s["b"]),
    )
    return F.coalesce(F.forall(good, lambda x: x), F.lit(True))


def as_text(spans: Column) -> Column:
    """Readable form "a-b;c-d" with 4 digits; NULL stays NULL."""
    return F.when(
        spans.isNotNull(),
        F.array_join(
            F.transform(
                spans,
                lambda s: F.concat(
                    F.format_string("%.4f", s["a"]), F.lit("-"), F.format_string("%.4f", s["b"])
                ),
            ),
            ";",
        ),
    )
