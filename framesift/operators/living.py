"""A registry of speakers that grows input by input: match, create, add, round after round.

The registry is a table of versions in a folder. A round reads the newest row per speaker, matches the clusters of
its inputs, and writes back the rows it changed or created, nothing else; every COMPACT-th version is the whole table,
so no read opens more than COMPACT versions. Batches and streams run the same round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.operators.identity import MATCH, add_vectors, leader_clusters, match_registry
from framesift.operators.joins import spread_join
from framesift.operators.ordered import positions, top_k
from framesift.session import checkpointed, workspace

COMPACT = 16
SPEAKER = ("speaker long, face_sum array<double>, face_n long, voice_sum array<double>, voice_n long, channels array<string>, inputs array<string>, "
           "photos array<string>, review string, kept long, suggestion long, suggestion_sim double")
CLIP = "round long, input_id string, one boolean, clip_id long, face array<double>, voice array<double>, channel string, video string, quality double"


@dataclass(frozen=True)
class Rules:
    """Thresholds and counts of the identify step."""

    match: dict = field(default_factory=lambda: dict(MATCH))
    cluster: float = 0.45
    least: int = 3  # clips of an unmatched cluster that make a new speaker
    face_outlier: float = 0.35
    voice_outlier: float = 0.35
    photos: int = 3
    per_speaker: int | None = None  # a finished speaker with fewer kept clips opens again; None: always


class Store:
    """Versions of the registry in one folder; a version written twice is replaced."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or workspace(spark, "speakers")

    def _read(self, first: int, before: int) -> DataFrame:
        known = self._versions()
        paths = [f"{self.path}/v={n}" for n in range(max(first, 0), before) if n in known]
        return self.spark.read.schema(SPEAKER + ", version long").parquet(*paths) if paths else self.spark.createDataFrame([], SPEAKER + ", version long")

    def _versions(self) -> set[int]:
        """Version numbers that are there, listed through the file system Spark writes to."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return set()
        return {int(s.getPath().getName()[2:]) for s in system.listStatus(folder) if s.getPath().getName().startswith("v=")}

    def before(self, version: int) -> DataFrame:
        """The newest row of every speaker among the versions before this one."""
        rows = self._read((version - 1) // COMPACT * COMPACT, version)
        names = [f.name for f in self.spark.createDataFrame([], SPEAKER).schema if f.name != "speaker"]
        newest = rows.groupBy("speaker").agg(F.max_by(F.struct(*names), "version").alias("r"))
        return newest.select("speaker", *[F.col(f"r.{n}").alias(n) for n in names])

    def write(self, changed: DataFrame, old: DataFrame, version: int) -> None:
        if version % COMPACT == 0:
            changed = changed.unionByName(old.join(changed.select("speaker"), "speaker", "left_anti"))
        changed.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/v={version}")

    def import_rows(self, rows: DataFrame) -> None:
        """Start from known speakers, as version 0."""
        rows.withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{self.path}/v=0")


def _sum(name: str, size: int) -> Column:
    return V.vector_sum(name, size)


def clustered(clips: DataFrame, rules: Rules) -> DataFrame:
    """Add cluster: everything of a one-speaker input is cluster 0, other inputs are clustered by face."""
    one = clips.where("one").select("input_id", "clip_id", F.lit(0).cast("long").alias("cluster"))
    several = clips.where("NOT one").select("input_id", "clip_id", "face")
    if several.isEmpty():
        return clips.withColumn("cluster", F.lit(0).cast("long"))
    many = leader_clusters(several, "input_id", "clip_id", "face", rules.cluster)
    return clips.join(one.unionByName(many.select("input_id", "clip_id", F.col("cluster").cast("long").alias("cluster"))), ["input_id", "clip_id"])


def identify_round(registry: DataFrame, clips: DataFrame, size: int, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(assigned clips, changed speakers) of one round.

    Clusters of the round are matched with the registry as it was before it. An unmatched cluster becomes a new
    speaker, numbered on from the highest by input and cluster, or stays unassigned when it is small. Clips far
    from their cluster's centre get flags. Clips without a voice are matched by face alone.
    """
    rows = checkpointed(clustered(clips, rules).withColumn("probe", F.concat_ws("/", "input_id", "cluster")))
    centres = checkpointed(rows.groupBy("probe", "input_id", "cluster").agg(
        F.count(F.lit(1)).alias("n"), _sum("face", size).alias("fs"), F.count("voice").alias("vn"), _sum("voice", size).alias("vs"),
        F.array_sort(F.collect_set("channel")).alias("channels")))
    voiced = F.when(F.col("vn") > 0, V.normalize(F.col("vs")))
    probes = centres.select("probe", V.normalize(F.col("fs")).alias("face"), voiced.alias("voice"), "channels")
    known = registry.where("face_n > 0").select("speaker", V.normalize(F.col("face_sum")).alias("face"),
                                                F.when(F.col("voice_n") > 0, V.normalize(F.col("voice_sum"))).alias("voice"), "channels")
    found = match_registry(probes, "probe", known, "speaker", rules.match, voices=True)
    found = checkpointed(centres.join(found, "probe").join(probes.select("probe", F.col("face").alias("_face"), F.col("voice").alias("_voice")), "probe"))
    born = F.col("matched").isNull() & (F.col("n") >= rules.least)
    last = registry.agg(F.coalesce(F.max("speaker"), F.lit(0))).first()[0]
    fresh = positions(found.where(born).select("probe", "input_id", "cluster", F.lit(0).alias("_all")), ["_all"], ["input_id", "cluster"], "_at")
    fresh = fresh.select("probe", (F.col("_at") + F.lit(last + 1)).cast("long").alias("_new"))
    named = checkpointed(found.join(fresh, "probe", "left").withColumn("speaker", F.coalesce("matched", "_new")))
    how = F.when(F.col("speaker").isNull(), F.lit("unassigned")).otherwise(F.col("assign"))
    facts = named.select("probe", "speaker", how.alias("assign"), "_face", "_voice")
    out = spread_join(rows, facts, ["probe"], "inner", ["clip_id"])
    far = F.when((V.dot(F.col("face"), F.col("_face")) < rules.face_outlier), F.lit("face_outlier"))
    off = F.when((V.dot(F.col("voice"), F.col("_voice")) < rules.voice_outlier), F.lit("voice_outlier"))
    assigned = out.select("input_id", "clip_id", "cluster", "speaker", "assign", "video", "quality",
                          F.when(F.col("speaker").isNotNull(), F.concat_ws(",", far, off)).otherwise(F.lit("")).alias("flags"))
    assigned = checkpointed(assigned)

    added = named.where("speaker IS NOT NULL").groupBy("speaker").agg(
        F.sum("n").alias("_n"), _sum("fs", size).alias("_fs"), F.sum("vn").alias("_vn"), _sum("vs", size).alias("_vs"),
        F.array_distinct(F.flatten(F.collect_list("channels"))).alias("_channels"), F.collect_set("input_id").alias("_inputs"),
        F.max(F.when(F.col("matched").isNull(), F.struct("suggestion", "sim"))).alias("_hint"))
    shots = assigned.where("speaker IS NOT NULL").groupBy("speaker", "video").agg(F.max("quality").alias("quality"))
    taken = registry.select("speaker", F.explode("photos").alias("video"))
    shots = top_k(shots.join(taken, ["speaker", "video"], "left_anti"), ["speaker"], ["-quality", "video"], rules.photos)
    shots = shots.groupBy("speaker").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "video"))), lambda x: x["video"]).alias("_shots"))
    old = registry.join(added.select("speaker"), "speaker", "left_semi")
    both = added.join(shots, "speaker", "left").join(old, "speaker", "left")
    none = F.array().cast("array<string>")
    sets = lambda a, b: F.array_sort(F.array_union(F.coalesce(F.col(a), none), F.coalesce(F.col(b), none)))
    short = F.lit(True) if rules.per_speaker is None else F.coalesce("kept", F.lit(0)) < rules.per_speaker
    changed = both.select(
        "speaker", add_vectors(F.col("face_sum"), F.col("_fs")).alias("face_sum"), (F.coalesce("face_n", F.lit(0)) + F.col("_n")).cast("long").alias("face_n"),
        F.when(F.col("_vn") > 0, add_vectors(F.col("voice_sum"), F.col("_vs"))).otherwise(F.col("voice_sum")).alias("voice_sum"),
        (F.coalesce("voice_n", F.lit(0)) + F.col("_vn")).cast("long").alias("voice_n"), sets("channels", "_channels").alias("channels"), sets("inputs", "_inputs").alias("inputs"),
        F.slice(F.concat(F.coalesce("photos", none), F.coalesce("_shots", none)), 1, rules.photos).alias("photos"),
        F.when(F.col("review").isNull() | ((F.col("review") == "done") & short), F.lit("pending")).otherwise(F.col("review")).alias("review"),
        F.coalesce("kept", F.lit(0)).cast("long").alias("kept"),
        F.when(F.col("face_n").isNull(), F.col("_hint.suggestion")).otherwise(F.col("suggestion")).cast("long").alias("suggestion"),
        F.when(F.col("face_n").isNull() & F.col("_hint.suggestion").isNotNull(), F.col("_hint.sim")).otherwise(F.col("suggestion_sim")).alias("suggestion_sim"))
    return assigned, checkpointed(changed)


def identify(clips: DataFrame, store: Store, size: int, rules: Rules = Rules(), first: int = 1) -> DataFrame:
    """Assignments of all clips, round by round in order of `round`; version `first` + i holds round i.

    A round is one Spark pass over its clips, so what arrives together belongs in one round; their numbers
    are read to the driver.
    """
    out = None
    for i, row in enumerate(clips.select("round").distinct().orderBy("round").collect()):
        old = checkpointed(store.before(first + i))
        assigned, changed = identify_round(old, clips.where(F.col("round") == row[0]), size, rules)
        store.write(changed, old, first + i)
        assigned = assigned.drop("video", "quality").withColumn("round", F.lit(row[0]))
        out = assigned if out is None else out.unionByName(assigned)
    if out is None:
        return clips.sparkSession.createDataFrame([], "input_id string, clip_id long, cluster long, speaker long, assign string, flags string, round long")
    return out


def identify_stream(clips: DataFrame, store: Store, size: int, rules: Rules = Rules()) -> DataFrame:
    """The stream twin: one micro-batch is one round. Returns the assignments written so far.

    A replayed batch reads the versions before its own and replaces what it wrote, so retries change nothing.
    """
    rows = f"{store.path}-rows"

    def step(batch: DataFrame, number: int) -> None:
        old = checkpointed(store.before(number + 1))
        assigned, changed = identify_round(old, checkpointed(batch), size, rules)
        store.write(changed, old, number + 1)
        assigned.drop("video", "quality").withColumn("round", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{rows}/batch={number}")

    job = clips.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{store.path}-state").foreachBatch(step).start()
    job.awaitTermination()
    return store.spark.read.parquet(rows).drop("batch")
