"""Sync curves and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 31 lags, index i ↔ audio lag i − 15.
MAX_LAG = 15
CURVE = 2 * MAX_LAG + 1


def load_curves(documents: DataFrame, text: str, key: str = "cos") -> DataFrame:
    """JSON texts {"samples": {id: {key: [31 numbers]}}} → (sample_id, curve).

    A curve of another length is dropped, a JSON null inside a curve becomes NaN.
    """
    schema = f"struct<samples:map<string,struct<`{key}`:array<double>>>>"
    entries = documents.select(F.explode(F.from_json(text, schema)["samples"]).alias("sample_id", "e"))
    curve = F.transform(F.col("e")[key], lambda x: F.coalesce(x, F.lit(float("nan"))))
    return entries.select("sample_id", curve.alias("curve")).where(F.size("curve") == CURVE)


def save_predictions(scores: DataFrame, tasks: list[str]) -> DataFrame:
    """Long (sample_id, task, score) → one row per sample, missing score = NaN."""
    wide = scores.groupBy("sample_id").pivot("task", tasks).agg(F.max("score"))
    return wide.select(
        "sample_id",
        *[F.coalesce(F.col(t), F.lit(float("nan"))).alias(f"video_{t}") for t in tasks],
    )


def load_predictions(wide: DataFrame, task: str) -> DataFrame:
    """(sample_id, score) of one task; only that column is read."""
    return wide.select("sample_id", F.col(f"video_{task}").alias("score"))


def known_score(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column)


def first_root(files: DataFrame, wanted: DataFrame, key: str, roots: list[str]) -> DataFrame:
    """First root, in the given order, that has the file; the first root when none has it."""
    order = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root"))
    listed = files.where(F.col("root").isin(roots)).groupBy(key).agg(F.min(order).alias("at"))
    names = F.array(*[F.lit(r) for r in roots])
    return wanted.join(listed, key, "left").select(
        key, F.element_at(names, F.coalesce("at", F.lit(1)).cast("int")).alias("root"),
        F.col("at").isNotNull().alias("found"),
    )
