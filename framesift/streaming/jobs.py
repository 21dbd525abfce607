"""Structured Streaming twins of the ordered operators.

A finished run leaves one folder per micro-batch in the shared folder; a replayed batch overwrites
its own folder, so retries do not double rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framesift.functions import vectors as V
from framesift.session import workspace


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table, a file or a folder of files, as a stream with the schema of the table.

    The last letter stands in brackets because a stream takes a single file only by a pattern.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str, delay: str) -> DataFrame:
    rows = table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Process everything available and return the written rows with their `batch` number."""
    spark = stream.sparkSession
    path = workspace(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    job = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
           .option("checkpointLocation", f"{path}/state").foreachBatch(write).start())
    job.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row per key of an update- or complete-mode run."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions per key; rows at most `gap` apart belong together."""
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return out.select(key, F.col("w.start").alias("start"), "last", "n")


def newest(rows: DataFrame) -> DataFrame:
    """Rows of the last batch of a complete-mode run."""
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def blocks(events: DataFrame, key: str, width: str, value: str, order: str) -> DataFrame:
    """First value and later rows per fixed block; rows behind the watermark are dropped and counted
    by the engine (numRowsDroppedByWatermark)."""
    out = events.groupBy(key, F.window("ts", width).alias("w")).agg(
        F.min_by(value, F.struct("ts", order)).alias("value"), (F.count(F.lit(1)) - 1).alias("skipped"))
    return out.select(key, F.col("w.start").alias("start"), "value", "skipped")


def sliding(events: DataFrame, key: str, width: str, step: str, good: Column) -> DataFrame:
    out = events.groupBy(key, F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("inside"), F.sum(good.cast("long")).alias("valid"))
    return out.select(key, F.col("w.start").alias("start"), "inside", "valid")


def track(events: DataFrame, key: str, columns: str, max_gap: int = 2) -> DataFrame:
    """Face continuity with one small state per key: last valid box and the misses since.

    events(key, ts, event_id, faces, ok_geometry, x, y, w, h); `columns` is the DDL of the key.
    """
    def step(names, chunks, state: GroupState):
        x0 = y0 = w0 = h0 = None
        missed = 0
        if state.exists:
            x0, y0, w0, h0, missed = state.get
        pdf = pd.concat(list(chunks)).sort_values(["ts", "event_id"])
        out = []
        for n, good, x, y, w, h in zip(*[pdf[c] for c in ("faces", "ok_geometry", "x", "y", "w", "h")]):
            ok = n == 1 and bool(good)
            if ok and w0 is not None:
                dx, dy = x + w / 2 - x0 - w0 / 2, y + h / 2 - y0 - h0 / 2
                ok = (dx * dx + dy * dy) ** 0.5 < max(w, h) * 0.6 and 0.5 < w / w0 < 2
            out.append(ok)
            if ok:
                x0, y0, w0, h0, missed = x, y, w, h, 0
            else:
                missed += 1
                if missed > max_gap:
                    x0 = y0 = w0 = h0 = None
        state.update((x0, y0, w0, h0, missed))
        yield pd.DataFrame({key: names[0], "event_id": pdf["event_id"].to_numpy(), "valid": out})

    return events.groupBy(key).applyInPandasWithState(
        step, f"{columns}, event_id long, valid boolean", "x double, y double, w double, h double, missed long",
        "append", GroupStateTimeout.NoTimeout)


def registry_stream(points: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Registry of running sums fed batch by batch: version n = version n − 1 + the sums of batch n."""
    spark, path = points.sparkSession, workspace(points.sparkSession, "registry")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), V.vector_sum(vector, size).alias("s"))
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{path}/versions/v={number - 1}")
            new = old.unionByName(new).groupBy(key).agg(F.sum("n").alias("n"), V.vector_sum("s", size).alias("s"))
        new.write.mode("overwrite").parquet(f"{path}/versions/v={number}")

    job = (points.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
           .foreachBatch(merge).start())
    job.awaitTermination()
    versions = spark.read.parquet(f"{path}/versions")
    return versions.where(F.col("v") == versions.agg(F.max("v")).scalar()).drop("v")
