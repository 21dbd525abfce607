"""The generation plan: one table of voice and lip-sync jobs, and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.hashing import stable_int
from framesift.operators.allocate import assign_generators, rotate_voices
from framesift.operators.donors import donors
from framesift.operators.joins import reference_of, spread_join
from framesift.operators.ordered import HOT_ROWS, positions
from framesift.session import checkpointed

KEY_LENGTH = 20


def job_key(kind: str, *parts: Column) -> Column:
    """Hash of the JSON list [kind, parts…], numbers bare and texts quoted, cut to KEY_LENGTH digits."""
    text = F.concat(F.lit(f'["{kind}"'), *[x for p in parts for x in (F.lit(", "), p)], F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, KEY_LENGTH)


def plan_jobs(clips: DataFrame, generators: dict[str, list[str]], voices: dict[str, list[str]], per_clip: int, seed: str, shorter: float = 0.0,
              inpaint: dict[str, str] | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(split, clip_id, type, key, arm, cell, inpaint, donor, pool, reference, voice_key): one row per job.

    `clips` has split, speaker_id, clip_id, source_id, start_s, end_s and duration_s; splits without generators
    get no jobs. Each clip has one voice job, whose voice rotates from clip to clip and starts one further for
    each speaker of the split, and `per_clip` lip-sync jobs. A donor cell without any donor becomes a source
    cell. The donor stands in voice jobs and donor cells, the key of the clip's voice job in cells "both".
    """
    group, jobs = ["split", "speaker_id"], None
    slim = clips.select(*group, "clip_id", "source_id", "start_s", "end_s", "duration_s")
    donor = donors(slim, group, "clip_id", "duration_s", "source_id", "start_s", "end_s", shorter, seed, hot_rows=hot_rows).select("clip_id", "donor", "pool")
    reference = reference_of(slim, group, "clip_id", "source_id", "duration_s").select("clip_id", "reference")
    turn = positions(slim.select(*group).distinct(), ["split"], ["speaker_id"], "_turn", hot_rows)
    # Written before the next join counts its rows, which would find all donors a second time.
    known = checkpointed(slim.select(*group, "clip_id").join(donor, "clip_id").join(reference, "clip_id"))
    known = checkpointed(spread_join(known, turn, group, spread=["clip_id"], hot_rows=hot_rows))
    voice_key = job_key("voice", F.col("clip_id").cast("string"))
    for split, names in voices.items():
        mine = known.where(F.col("split") == split)
        first = F.col("_turn") + stable_int(F.lit(f"{seed}:voices"))
        voice = rotate_voices(mine, "speaker_id", "clip_id", names, first, hot_rows).select(
            "split", "clip_id", F.lit("voice").alias("type"), voice_key.alias("key"), F.col("voice").alias("arm"), F.lit("voice").alias("cell"),
            F.lit((inpaint or {}).get(split)).cast("string").alias("inpaint"), "donor", "pool", "reference", F.lit(None).cast("string").alias("voice_key"))
        lip = assign_generators(mine.select("split", "clip_id"), "split", "clip_id", generators[split], per_clip, seed, hot_rows).join(mine.select("clip_id", "donor", "pool"), "clip_id")
        cell = F.when((F.col("cell") == "donor") & F.col("donor").isNull(), F.lit("source")).otherwise(F.col("cell"))
        key = job_key("lipsync", F.col("clip_id").cast("string"), F.concat(F.lit('"'), "generator", F.lit('"')))
        lip = lip.withColumn("cell", cell).select(
            "split", "clip_id", F.lit("lipsync").alias("type"), key.alias("key"), F.col("generator").alias("arm"), "cell", F.lit(None).cast("string").alias("inpaint"),
            F.when(F.col("cell") == "donor", F.col("donor")).alias("donor"), F.when(F.col("cell") == "donor", F.col("pool")).alias("pool"),
            F.lit(None).cast(clips.schema["clip_id"].dataType).alias("reference"), F.when(F.col("cell") == "both", voice_key).alias("voice_key"))
        both = voice.unionByName(lip)
        jobs = both if jobs is None else jobs.unionByName(both)
    return jobs


def summarize_plan(jobs: DataFrame) -> DataFrame:
    """(split, type, cell, arm, jobs, without_donor): counts of the plan; without_donor counts voice jobs only."""
    alone = F.count_if((F.col("type") == "voice") & F.col("donor").isNull()).alias("without_donor")
    return jobs.groupBy("split", "type", "cell", "arm").agg(F.count(F.lit(1)).alias("jobs"), alone)
