"""Table-level checks and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.operators.ordered import top_k


def repeats(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Add `name`: True on every row of a key but its first in `order`. NULL keys never repeat."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    out = df.join(first, key, "left")
    return out.withColumn(name, F.coalesce(F.col(order) != F.col("_first"), F.lit(False))).drop("_first")


def crossing(df: DataFrame, content: str, group: str) -> DataFrame:
    """Contents found in more than one group, with both ends of the group range."""
    ends = df.groupBy(content).agg(F.min(group).alias("first_group"), F.max(group).alias("last_group"),
                                   F.count(F.lit(1)).alias("n"))
    return ends.where(F.col("first_group") != F.col("last_group"))


def selection(split: Column, cell: Column, splits: list[str] | None = None,
              cells: list[str] | None = None) -> Column:
    """Optional IN filters: an absent list lets everything through."""
    a = split.isin(splits) if splits else F.lit(True)
    b = cell.isin(cells) if cells else F.lit(True)
    return a & b


def wanted(cell: Column, kind: Column, lipsync: list[str]) -> Column:
    return (cell == "real") | (cell.isin(lipsync) & (kind == "full"))


def smoke_subset(df: DataFrame, split: str, speaker: str, k: int) -> DataFrame:
    """All rows of the first k speakers by name in each split. The kept list has k × splits rows."""
    names = df.where(F.col(speaker).isNotNull()).select(split, speaker).distinct()
    kept = top_k(names, [split], [speaker], k).select(speaker).distinct()
    return df.join(F.broadcast(kept), speaker, "left_semi")


def task_labels(df: DataFrame, ident: list[str], tasks: dict[str, Column]) -> DataFrame:
    """(ident, task, y) for every known label; NULL labels are dropped per task."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), c.cast("long").alias("y")) for t, c in tasks.items()
    ])).alias("p")
    return df.select(*ident, pairs).select(*ident, "p.task", "p.y").where("y IS NOT NULL")


def gate_subset(df: DataFrame, label: str, key: str, seen: DataFrame | None = None,
                cell: tuple[str, str] | None = None) -> DataFrame:
    """Negatives plus the positives of unseen values of `key` (or of one cell).

    `seen(key)` is the list of generators or voices met in training, a configuration-sized list.
    """
    positive = F.col(label) == 1
    if cell is not None:
        return df.where(~positive | (F.col(cell[0]) == cell[1]))
    marked = df.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    unseen = F.col(key).isNotNull() & (F.col(key) != "none") & F.col("_seen").isNull()
    return marked.where(~positive | unseen).drop("_seen")


def ready_speakers(speakers: DataFrame, clips: DataFrame, lo: int, hi: int) -> DataFrame:
    """Reviewed, unmerged, with a gender, not in a part yet, and lo..hi kept clips."""
    kept = clips.where("decision = 'keep'").groupBy("speaker_id").agg(F.count(F.lit(1)).alias("kept"))
    rows = speakers.join(kept, "speaker_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return rows.where(
        (F.col("review") == "done") & (F.col("merged_into") == "") & F.col("gender").isin("M", "F")
        & F.col("part").isNull() & F.col("kept").between(lo, hi))
