"""The ledger as parquet tables: keyed upsert, CSV snapshot, dated backups, event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Last write wins per key. One struct maximum per key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    )
    return latest.select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def csv_view(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Flat copy for spreadsheets: JSON columns dropped, vectors become yes / empty."""
    out = []
    for field in df.schema.fields:
        if field.name in (drop or []):
            continue
        if isinstance(field.dataType, T.ArrayType):
            out.append(F.when(F.col(field.name).isNotNull(), F.lit("yes")).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def backup(df: DataFrame, path: str, stamp: str) -> None:
    """Add one dated snapshot; earlier ones stay."""
    df.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("snapshot").parquet(path)


def kept_snapshots(spark: SparkSession, path: str, keep: int) -> DataFrame:
    """Rows of the newest `keep` snapshots. The snapshot list comes from the folder names."""
    rows = spark.read.parquet(path).withColumn("snapshot", F.col("snapshot").cast("string"))
    newest = rows.select("snapshot").distinct().orderBy(F.col("snapshot").desc()).limit(keep)
    return rows.join(F.broadcast(newest), "snapshot")  # at most `keep` rows


def log_events(df: DataFrame, path: str) -> None:
    """Append (at, step, message) rows."""
    df.select("at", "step", "message").write.mode("append").parquet(path)


def write_batch_lists(videos: DataFrame, inputs: DataFrame, key: str, batch: str, path: str) -> None:
    """One CSV folder per batch with the joined source rows."""
    videos.join(inputs, key).write.partitionBy(batch).option("header", True).csv(path)


def export_bundle(clips: DataFrame, videos: DataFrame, speakers: DataFrame, path: str) -> None:
    """Table part of a bundle: manifest, speakers and split lock.

    clips(clip_id, video_id, speaker_id, split, …), videos(video_id, channel, …),
    speakers(speaker_id, gender, …).
    """
    rows = clips.join(videos, "video_id").join(speakers, "speaker_id")
    rows.write.json(f"{path}/manifest")
    roll = rows.groupBy("speaker_id").agg(
        F.first("gender").alias("gender"), F.min("split").alias("split"),
        F.count(F.lit(1)).alias("clips"),
        F.concat_ws(";", F.array_sort(F.collect_set("channel"))).alias("channels"),
        F.count_distinct("video_id").alias("videos"),
    )
    roll.write.parquet(f"{path}/speakers")
    lock = rows.select("clip_id", "split", "speaker_id", "video_id")
    lock.write.parquet(f"{path}/split_lock")
