"""Status and report aggregates over the ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def batch_status(videos: DataFrame) -> DataFrame:
    """videos(batch, duration_s, est_mb, size_mb, dl_status, cut_status) → one row per batch."""
    done = F.col("dl_status") == "done"
    return videos.groupBy("batch").agg(
        F.count(F.lit(1)).alias("videos"), F.round(F.sum("duration_s") / 3600, 1).alias("hours"),
        F.round(F.sum("est_mb") / 1000, 1).alias("est_gb"), hits(done).alias("downloaded"),
        hits(F.col("dl_status") == "failed").alias("dl_failed"),
        F.round(F.coalesce(F.sum(F.when(done, F.col("size_mb"))), F.lit(0.0)) / 1000, 2).alias("size_gb"),
        hits(F.col("cut_status") == "done").alias("cut"), hits(F.col("cut_status") == "failed").alias("cut_failed"))


def tally(df: DataFrame, section: str, key: Column) -> DataFrame:
    """(section, key, n) of one status column."""
    return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")


def review_state(speakers: DataFrame, clips: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per live speaker: clips, kept clips and whether it is ready for a part."""
    counts = clips.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("clips"), hits(F.col("decision") == "keep").alias("keep"))
    out = speakers.join(counts, "speaker_id", "left").fillna(0, ["clips", "keep"])
    ready = (F.col("review") == "done") & F.col("keep").between(lo, hi) & F.col("part").isNull()
    return out.withColumn("ready", ready)


def joined_set(column: str) -> Column:
    """Distinct values of a small attribute set, sorted and joined by ";"."""
    return F.array_join(F.array_sort(F.collect_set(column)), ";")


def reason_map(df: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """keys → map reason → count, built from counts (one entry per reason, not per row)."""
    counts = df.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_n")))).alias("rejected"))


def leftovers(clips: DataFrame, speakers: DataFrame, batches: DataFrame) -> DataFrame:
    """Local clips never used: not kept, of a decided speaker. Deletable once the raw batch is stored
    elsewhere, else waiting."""
    rows = clips.where("location = 'local' AND decision <> 'keep'").join(
        speakers.where(F.col("review").isin("done", "excluded")).select("speaker_id"), "speaker_id", "left_semi")
    out = rows.join(batches.select("batch", F.col("location").alias("raw")), "batch", "left")
    return out.withColumn("action", F.when(F.coalesce("raw", F.lit("")).startswith("drive:"), F.lit("delete")).otherwise(F.lit("wait")))


# The only allowed next status of a location.
NEXT = {"local": "packed", "packed": "uploaded", "uploaded": "deleted"}


def transition(rows: DataFrame, status: str, wanted: str, finished: Column) -> DataFrame:
    """Add new_status and problem: steps out of order and unfinished work are refused."""
    allowed = F.lit(None).cast("string")
    for a, b in NEXT.items():
        allowed = F.when(F.col(status) == a, F.lit(b)).otherwise(allowed)
    order = allowed.eqNullSafe(F.col(wanted))
    problem = F.when(~order, F.lit("out of order")).when((F.col(wanted) == "packed") & ~finished, F.lit("unfinished"))
    return rows.withColumn("problem", problem).withColumn("new_status", F.when(problem.isNull(), F.col(wanted)).otherwise(F.col(status)))
