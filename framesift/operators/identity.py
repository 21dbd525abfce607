"""Who is on screen: matching vectors to a registry of running sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.functions import vectors as V
from framesift.operators.ordered import HOT_ROWS, positions, running, top_k
from framesift.session import checkpointed

# Cosine thresholds of the match rule.
MATCH = {"high": 0.55, "low": 0.35, "margin": 0.08, "voice_low": 0.35}

PROBES_PER_TASK, CENTROIDS_PER_TASK = 20_000, 2_048


def centroids(points: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, n, sum, centre): element-wise sums by partial aggregation, centre = normalised sum."""
    sums = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), V.vector_sum(vector, size).alias("sum"))
    return sums.withColumn("centre", V.normalize(F.col("sum")))


def best_matches(probes: DataFrame, ident: str, vector: str, registry: DataFrame, key: str, centre: str,
                 k: int = 2, own: str | None = None, tag: str | None = None) -> DataFrame:
    """The k most similar registry entries per probe → (ident, rank, key, sim, same_tag).

    Probes and registry are cut into shards and blocks of bounded size and every (shard, block)
    pair is one matrix product in one task. Only k rows per probe and block leave it, never the
    pairs. `own`: probe column with the registry key to leave out. `tag`: integer-array column on
    both sides; the best entry sharing a tag is returned too, marked same_tag.
    """
    shards = max(1, -(-probes.count() // PROBES_PER_TASK))
    blocks = max(1, -(-registry.count() // CENTROIDS_PER_TASK))
    extra = [own] if own else []
    tags = [tag] if tag else []
    left = probes.select(ident, F.col(vector).alias("_v"), *extra, *tags,
                         F.pmod(F.xxhash64(ident), F.lit(shards)).cast("int").alias("_shard"))
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = registry.select(F.col(key).alias("_key"), F.col(centre).alias("_c"), *tags,
                            F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"))
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    kinds = dict(probes.dtypes)[ident], dict(registry.dtypes)[key]
    schema = f"{ident} {kinds[0]}, {key} {kinds[1]}, sim double, same_tag boolean"

    def incidence(lists, names):
        at = {n: i for i, n in enumerate(names)}
        out = np.zeros((len(lists), max(1, len(names))))
        for i, items in enumerate(lists):
            for n in items if items is not None else ():
                out[i, at[n]] = 1
        return out

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return none
        b = b.sort_values("_key")
        names = b["_key"].to_numpy()
        sims = np.stack(a["_v"].to_numpy()).astype(float) @ np.stack(b["_c"].to_numpy()).astype(float).T
        if own:
            sims[a[own].to_numpy()[:, None] == names[None, :]] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        frames = [(top, np.zeros(len(a), bool))]
        if tag:
            known = sorted({n for items in [*a[tag], *b[tag]] if items is not None for n in items})
            shared = incidence(a[tag], known) @ incidence(b[tag], known).T > 0
            held = np.where(shared, sims, -np.inf)
            frames.append((np.argmax(held, axis=1)[:, None], np.ones(len(a), bool)))
        out = []
        for cols, same in frames:
            value = np.take_along_axis(sims if not same[0] else held, cols, axis=1)
            out.append(pd.DataFrame({
                ident: np.repeat(a[ident].to_numpy(), cols.shape[1]), key: names[cols.ravel()],
                "sim": value.ravel(), "same_tag": bool(same[0])}))
        rows = pd.concat(out)
        rows = rows[np.isfinite(rows["sim"])]
        return rows if len(rows) else none

    none = pd.DataFrame({ident: pd.Series(dtype=object), key: pd.Series(dtype=object), "sim": pd.Series(dtype=float), "same_tag": pd.Series(dtype=bool)})
    found = left.groupBy("_shard", "_block").cogroup(right.groupBy("_s", "_b")).applyInPandas(score, schema)
    return top_k(found, [ident, "same_tag"], ["-sim", key], k)


def match_registry(probes: DataFrame, ident: str, registry: DataFrame, key: str, rules: dict | None = None,
                   voices: bool = False) -> DataFrame:
    """(ident, matched, assign, suggestion, sim) for probes(ident, face, channels[, voice]) against
    registry(key, face, channels[, voice]).

    A same-channel entry at or above `high` wins; else the best overall at or above `high` with the
    margin; at or above `low` it is a suggestion. A voice below `voice_low` vetoes a match.
    """
    r = {**MATCH, **(rules or {})}
    found = best_matches(probes, ident, "face", registry, key, "face", 2, tag="channels")

    def pick(cond, column):
        return F.max(F.when(cond, F.col(column)))

    first = (F.col("rank") == 1) & ~F.col("same_tag")
    wide = found.groupBy(ident).agg(
        pick(first, key).alias("_best"), pick(first, "sim").alias("_sim"),
        pick((F.col("rank") == 2) & ~F.col("same_tag"), "sim").alias("_second"),
        pick((F.col("rank") == 1) & F.col("same_tag"), key).alias("_same"),
        pick((F.col("rank") == 1) & F.col("same_tag"), "sim").alias("_same_sim"))
    rows = probes.join(wide, ident, "left")
    ok = {"_best": F.lit(True), "_same": F.lit(True)}
    if voices:
        for name in ok:
            heard = registry.select(F.col(key).alias(name), F.col("voice").alias(f"{name}_voice"))
            rows = rows.join(heard, name, "left")
            ok[name] = F.coalesce(V.dot(F.col("voice"), F.col(f"{name}_voice")) >= r["voice_low"], F.lit(True))
    channel = F.coalesce((F.col("_same_sim") >= r["high"]) & ok["_same"], F.lit(False))
    margin = F.col("_sim") - F.coalesce("_second", F.lit(-1.0)) >= r["margin"]
    overall = F.coalesce((F.col("_sim") >= r["high"]) & margin & ok["_best"], F.lit(False))
    low = F.coalesce(F.col("_sim") >= r["low"], F.lit(False))
    return rows.select(
        ident, F.when(channel, F.col("_same")).when(overall, F.col("_best")).alias("matched"),
        F.when(channel, F.lit("auto_channel")).when(overall, F.lit("auto")).otherwise(F.lit("new")).alias("assign"),
        F.when(~channel & ~overall & low, F.col("_best")).alias("suggestion"), F.col("_sim").alias("sim"))


class Leaders:
    """Running sums of the clusters of one block, and their unit centres."""

    def __init__(self, width: int):
        self.sums, self.centres = np.empty((0, width)), np.empty((0, width))

    def _centre(self, i: int) -> None:
        self.centres[i] = self.sums[i] / max(float(np.sqrt(self.sums[i] @ self.sums[i])), 1e-8)

    def take(self, vector: np.ndarray, threshold: float) -> None:
        """Add a vector to the closest leader, or let it lead."""
        near = self.centres @ vector
        i = int(near.argmax()) if len(near) else -1
        if i < 0 or near[i] < threshold:
            i = len(self.sums)
            self.sums, self.centres = (np.append(x, np.zeros((1, x.shape[1])), 0) for x in (self.sums, self.centres))
        self.sums[i] += vector
        self._centre(i)

    def joined(self, threshold: float) -> np.ndarray:
        """Unit centres after the closest two have been joined for as long as they reach the threshold;
        only the similarities of the joined centre are worked out again."""
        n = len(self.sums)
        alike = np.where(np.triu(np.ones((n, n), bool), 1), self.centres @ self.centres.T, -np.inf)
        gone = np.zeros(n, bool)
        while n - gone.sum() > 1:
            keep, lost = np.unravel_index(int(alike.argmax()), alike.shape)
            if alike[keep, lost] < threshold:
                break
            self.sums[keep] += self.sums[lost]
            self._centre(keep)
            gone[lost] = True
            alike[lost, :] = alike[:, lost] = -np.inf
            fresh = np.where(gone, -np.inf, self.centres @ self.centres[keep])
            alike[keep, keep + 1:], alike[:keep, keep] = fresh[keep + 1:], fresh[:keep]
        return self.centres[~gone]


def leader_clusters(points: DataFrame, block: str, order: str, vector: str, threshold: float) -> DataFrame:
    """points(block, order, vector) → adds cluster: join the closest leader at or above the threshold in
    order, join close centres, assign once more to the closest. A block is one input of any size.

    Leading is sequential: a block's sorted rows stream through one task whose state is the leaders.
    The second assignment is spread over tasks, each of which gets the block's centres first.
    """
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(points.dtypes)[block]

    def lead(batches):
        name, leaders = None, None

        def done():
            centres = leaders.joined(threshold)
            return pd.DataFrame({block: [name] * len(centres), "_cluster": np.arange(len(centres)), "_v": list(centres)})

        for pdf in batches:
            for key, row in zip(pdf[block], pdf["_v"]):
                if leaders is None or key != name:
                    if leaders is not None:
                        yield done()
                    name, leaders = key, Leaders(len(row))
                leaders.take(np.asarray(row, float), threshold)
        if leaders is not None:
            yield done()

    v = F.col(vector).cast("array<double>").alias("_v")
    led = points.select(block, order, v).repartition(block).sortWithinPartitions(block, order).mapInPandas(
        lead, f"{block} {kind}, _cluster long, _v array<double>")
    led = checkpointed(led)
    named = points.select(block, order, v, F.pmod(F.xxhash64(order), F.lit(spread)).alias("_salt"), F.lit(None).cast("long").alias("_cluster"))
    copied = led.select(block, F.lit(None).cast(dict(points.dtypes)[order]).alias(order), "_v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("_salt"), "_cluster")
    both = named.unionByName(copied).repartition(block, "_salt").sortWithinPartitions(block, "_salt", F.col("_cluster").asc_nulls_last())

    def assign(batches):
        name, centres, stacked = None, [], None
        for pdf in batches:
            found = []
            for key, salt, cluster, row in zip(pdf[block], pdf["_salt"], pdf["_cluster"], pdf["_v"]):
                if (key, salt) != name:
                    name, centres, stacked = (key, salt), [], None
                if not pd.isna(cluster):
                    centres.append(row)
                    found.append(-1)
                    continue
                if stacked is None:
                    stacked = np.stack(centres)
                found.append(int((stacked @ np.asarray(row, float)).argmax()))
            rows = np.array(found) >= 0
            if rows.any():
                yield pdf[[block, order]].assign(_cluster=found)[rows]

    closest = both.mapInPandas(assign, f"{block} {kind}, {order} {dict(points.dtypes)[order]}, _cluster long")
    closest = checkpointed(closest)
    used = closest.select(block, "_cluster").distinct()  # a centre that lost all its rows leaves no number behind
    number = (F.row_number().over(W.partitionBy(block).orderBy("_cluster")) - 1).alias("cluster")
    return points.join(closest.join(used.select(block, "_cluster", number), [block, "_cluster"]).drop("_cluster"), [block, order])


def add_vectors(a: Column, b: Column, sign: int = 1) -> Column:
    """a ± b element by element; NULL counts as zero."""
    return F.when(a.isNull(), F.transform(b, lambda x: x * sign)).when(b.isNull(), a).otherwise(
        F.zip_with(a, b, lambda x, y: x + sign * y))


def merged_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<bigint>")), F.coalesce(b, F.array().cast("array<bigint>"))))


def update_registry(registry: DataFrame, clips: DataFrame, key: str, size: int, photos: int, per_speaker: int) -> DataFrame:
    """Running sums, tag sets, photos and review state after adding clips.

    registry(key, face_sum, face_n, channels, review, kept), clips(key, face, channel, video,
    quality). Keys without an entry are created with the next order numbers. Photos come from the
    best clips of distinct videos. A finished speaker with fewer than `per_speaker` kept clips
    opens again.
    """
    new = clips.groupBy(key).agg(V.vector_sum("face", size).alias("_sum"), F.count(F.lit(1)).alias("_n"),
                                 F.collect_set("channel").alias("_channels"))
    per_video = clips.groupBy(key, "video").agg(F.max("quality").alias("quality"))
    shots = top_k(per_video, [key], ["-quality", "video"], photos).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "video"))).alias("_photos"))
    both = registry.join(new, key, "full_outer").join(shots, key, "left")
    born = F.col("face_n").isNull()
    last = registry.agg(F.coalesce(F.max("order_key"), F.lit(0))).scalar()
    rows = both.select(
        key, add_vectors(F.col("face_sum"), F.col("_sum")).alias("face_sum"),
        (F.coalesce("face_n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("face_n"),
        merged_sets(F.col("channels"), F.col("_channels")).alias("channels"),
        F.transform("_photos", lambda p: p["video"]).alias("photos"),
        F.when(born, F.lit("pending")).when((F.col("review") == "done") & F.col("_n").isNotNull() & (F.col("kept") < per_speaker), F.lit("pending"))
        .otherwise(F.col("review")).alias("review"), "order_key", born.cast("int").alias("_born"))
    numbered = positions(rows.where("_born = 1").withColumn("_all", F.lit(0)), ["_all"], [key], "_at").drop("_all")
    created = numbered.withColumn("order_key", (last + F.col("_at") + 1).cast("long")).drop("_at")
    return rows.where("_born = 0").unionByName(created).drop("_born")


def move_clips(registry: DataFrame, moves: DataFrame, key: str, size: int) -> DataFrame:
    """Registry sums after moves(from_key, to_key, face): subtract from one, add to the other; counts
    stop at 0."""
    steps = moves.select(F.col("from_key").alias(key), "face", F.lit(-1).alias("_sign")).unionByName(
        moves.select(F.col("to_key").alias(key), "face", F.lit(1).alias("_sign")))
    steps = steps.withColumn("face", F.transform("face", lambda x: x * F.col("_sign")))
    net = steps.groupBy(key).agg(V.vector_sum("face", size).alias("_sum"), F.sum("_sign").alias("_n"))
    out = registry.join(net, key, "left")
    return out.withColumn("face_sum", add_vectors(F.col("face_sum"), F.col("_sum"))).withColumn(
        "face_n", F.greatest(F.lit(0), F.col("face_n") + F.coalesce("_n", F.lit(0))).cast("long")).drop("_sum", "_n")


def merge_speakers(registry: DataFrame, merges: DataFrame, clips: DataFrame, key: str, size: int):
    """(registry, clips) after merges(key, into): sums and counts join, merged clips change speaker
    and a kept one waits for review again."""
    target = registry.join(merges, key, "left").withColumn("_to", F.coalesce("into", key))
    sums = target.groupBy(F.col("_to").alias(key)).agg(V.vector_sum("face_sum", size).alias("face_sum"), F.sum("face_n").alias("face_n"))
    moved = clips.join(merges, key, "left")
    gone = F.col("into").isNotNull()
    decision = F.when(gone & (F.col("decision") == "keep"), F.lit("pending")).otherwise(F.col("decision"))
    return sums, moved.withColumn("decision", decision).withColumn(key, F.coalesce("into", key)).drop("into")


def cap_decisions(requests: DataFrame, key: str, order: list[str], limit: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Requests in arrival order; a keep beyond `limit` per key is refused. Adds accepted."""
    keep = (F.col("decision") == "keep").cast("long")
    out = running(requests, [key], order, {"_kept": ("sum", keep)}, hot_rows=hot_rows)
    return out.withColumn("accepted", (keep == 0) | (F.col("_kept") <= limit)).drop("_kept")
