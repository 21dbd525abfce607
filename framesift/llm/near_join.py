"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens until buckets are small.

Tokens are hashed windows of five words. Texts with the same set are one node, so copies never meet in
pairs. Every run sends a set of n tokens to the buckets of tokens drawn with probability 1 / (0.8 n) by a
hash all sets share; too large buckets split again on further draws, and what stays too large by the rarest
tokens of each set, one of which similar sets share. Buckets are compared by bottom-k
sketches and give one edge per member, not all pairs. Each group so connected is then compared
exactly, in tiles of bounded size. The runs are as many as the target recall asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.tables import WORD, read, small_batches, written
from framesift.operators.components import connected_components

WIDTH, LEVEL = 5, 0.8  # words in a window; wanted similarity, as 4 / 5 in whole numbers below
RECALL = 1 - 1e-6  # of each pair at the wanted similarity
DEPTH, WIDER = 2, 2.0  # levels of splitting; draws at the lower ones, in units of 1 / LEVEL
BUCKET = 4096  # sets that are compared at once
SKETCH = 64
MISSED = 1e-8  # of the pairs at the wanted similarity, by their sketches
COMMON, COMMON_KEPT = 256, 100_000  # sets of too large buckets that make a token a common one; such tokens at most
TILE, TILE_TOKENS = 1024, 4_000_000  # sets and tokens that are compared exactly at once
CHECKED_BROADCAST = 1_000_000  # keys; beyond that the join shuffles
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def runs_for(recall: float = RECALL) -> int:
    """Runs after which a pair at the wanted similarity was together in a smallest bucket with `recall`.

    A pair shares at least LEVEL of the larger set, so one level keeps it with 1 - exp(-1) and each
    lower one with 1 - exp(-WIDER).
    """
    kept = (1 - math.exp(-1)) * (1 - math.exp(-WIDER)) ** (DEPTH - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def token_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's windows; a text of fewer than five words is one window, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(ids))
    mixed = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD[k] + ids[k:len(ids) - width + 1 + k]
    return np.unique(scrambled(mixed))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def chance(n: int, wider: float = 1.0) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(2**64 * wider / (LEVEL * n))))


def first_buckets(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Buckets of all runs: the hash of each drawn token, told apart by run."""
    if len(tokens) > 100_000:
        return np.concatenate([_drawn(tokens, seeds[i:i + 1], len(tokens)) for i in range(len(seeds))])
    return _drawn(tokens, seeds, len(tokens))


def _drawn(tokens: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    draws = tokens[None, :] * seeds[:, None]
    run, at = np.nonzero(draws <= chance(n))
    return scrambled(draws[run, at] ^ seeds[run] * ODD[3]).view(np.int64)


def run_seeds(runs: int) -> np.ndarray:
    return scrambled(np.arange(1, runs + 1, dtype=np.uint64) * ODD[0]) | np.uint64(1)


def _as_binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def node_of(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def described(docs: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    """(key, node, n, buckets, sketch): every document with its set's name, size, first-level buckets and
    least hashes, written once."""
    small_batches(docs.sparkSession)
    seeds, kind = run_seeds(runs), docs.schema[key].dataType.simpleString()

    def describe(batches):
        for b in batches:
            sets = [token_set(t) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([first_buckets(s, seeds) if len(s) else [] for s in sets], pa.list_(pa.int64())), _as_binary([sketch_of(s) for s in sets])],
                                             ["key", "node", "n", "buckets", "sketch"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(describe, f"key {kind}, node binary, n long, buckets array<bigint>, sketch binary"), "join_sets")


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The SKETCH least hashes of a set."""
    h = scrambled(tokens)
    return (np.sort(np.partition(h, SKETCH - 1)[:SKETCH] if len(h) > SKETCH else h) >> np.uint64(32)).astype(np.uint32)


def with_tokens(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """`wanted` (key, node, ...) with the tokens of each node, worked out anew from the texts; a node comes
    as often as rows repeat its key and text. Few wanted rows go to the texts, else both sides are shuffled."""
    side = F.broadcast(wanted) if wanted.count() <= CHECKED_BROADCAST else wanted
    more = [c for c in wanted.columns if c not in ("key", "node")]
    fields = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in more)

    def build(batches):
        for b in batches:
            sets = [token_set(t) for t in b["_text"].to_pylist()]
            same = np.flatnonzero([node_of(s) == n for s, n in zip(sets, b["node"].to_pylist())])
            at = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c].take(at) for c in ("node", *more)], _as_binary([sets[i] for i in same])], ["node", *more, "tokens"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    picked = rows.join(side, F.col("_key").eqNullSafe(F.col("key"))).select("_text", "node", *more)
    return picked.mapInArrow(build, ", ".join(x for x in ("node binary", fields, "tokens binary") if x))


def leaves(first: DataFrame, tokens_for) -> DataFrame:
    """(leaf, node): the buckets to compare, of at most BUCKET sets each, without those of one set."""
    rows, found = first, []
    for level in range(1, DEPTH + 1):
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
        large = written(counts.where(F.col("_n") > BUCKET), "join_large")
        if large.isEmpty():
            found.append(whole_buckets(rows))
            break
        found.append(whole_buckets(rows.join(large, "bucket", "left_anti")))
        again = rows.join(large, "bucket")
        if level == DEPTH:
            found += rare_buckets(tokens_for(again.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))))
            break
        again = again.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # buckets of one set, a few per run
        rows = written(tokens_for(again).mapInArrow(split, "bucket long, node binary").distinct(), "join_level")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def split(batches):
    """Children of (buckets, tokens): every bucket of a set drawn on by its own hash of the tokens."""
    for b in batches:
        bucket, node = [], []
        for old, name, raw in zip(b["buckets"].to_pylist(), b["node"].to_pylist(), b["tokens"].to_pylist()):
            tokens = np.frombuffer(raw, np.uint64)
            for parent in np.array(old, np.int64).view(np.uint64):
                draws = scrambled(tokens ^ parent)
                new = scrambled(draws[draws <= chance(len(tokens), WIDER)] ^ ODD[4] * (parent | np.uint64(1))).view(np.int64)
                bucket.append(new)
                node += [name] * len(new)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket) if bucket else [], pa.int64()), pa.array(node, pa.binary())], ["bucket", "node"])


def rare_buckets(rows: DataFrame) -> list[DataFrame]:
    """(leaf, node) of sets (node, tokens) by the tokens one of which every two similar sets share: the first
    fifth of a set, common tokens of all these sets last. Buckets still too large are cut into tiles, every two of which meet."""
    sets = written(rows.select("node", "tokens").where(F.length("tokens") > 0), "join_rest")

    def listed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b["tokens"].to_pylist()), np.int64))], ["token"])

    counts = sets.select("tokens").mapInArrow(listed, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    total = sets.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    common = counts.where(F.col("_n") >= max(COMMON, total / COMMON_KEPT))
    ranked = common.sort("token").toArrow()
    ranks = sets.sparkSession.sparkContext.broadcast([ranked[c].to_numpy() for c in ("token", "_n")])

    def first(batches):
        token, often = ranks.value
        for b in batches:
            bucket, node = [], []
            for name, raw in zip(b["node"].to_pylist(), b["tokens"].to_pylist()):
                own = np.frombuffer(raw, np.int64)
                at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
                n = np.where(token[at] == own, often[at], 0) if len(token) else np.zeros(len(own), np.int64)
                bucket.append(own[np.lexsort((own, n))[:prefix(len(own))]])
                node += [name] * len(bucket[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket) if bucket else [], pa.int64()), pa.array(node, pa.binary())], ["bucket", "node"])

    rows = written(sets.mapInArrow(first, "bucket long, node binary").distinct(), "join_rare")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.where(F.col("_n") > BUCKET), "join_large")
    if large.isEmpty():
        return [whole_buckets(rows)]
    tiles = F.ceil(F.col("_n") * 2 / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    tiled = rows.join(large, "bucket").withColumn("_own", own).withColumn("_other", other)
    return [whole_buckets(rows.join(large, "bucket", "left_anti")),
            tiled.select(F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("leaf"), "node")]


def prefix(n: int) -> int:
    """Tokens of a set of n, first in one order of all, one of which each similar set has among its own first ones."""
    return n - (4 * n + 4) // 5 + 1


def whole_buckets(rows: DataFrame) -> DataFrame:
    """Buckets as (leaf, node); buckets with the same members count once. None holds more than BUCKET sets."""
    lists = rows.groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    once = lists.groupBy(F.xxhash64("nodes").alias("leaf"), F.size("nodes").alias("_size")).agg(F.first("nodes").alias("nodes"))
    return once.select("leaf", F.explode("nodes").alias("node"))


def by_group(batches, name: str):
    """Consecutive rows with the same `name`, as tables, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b[name].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0][name][0].as_py() != ids[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared tokens of every two sets, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    own, token = owner[shared[token]], column[token[shared[token]]]
    columns = int(shared.sum())
    total, width = np.zeros((len(sets), len(sets)), np.float32), max(1, min(4096, columns))
    order = np.argsort(token, kind="stable")
    own, token = own[order], token[order]
    for lo in range(0, columns, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[own[a:b], token[a:b] - lo] = 1
        total += part @ part.T
    return total


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric 0/1 matrix, the smallest row it is connected with."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def least_shared() -> np.ndarray:
    """For the summed sizes of two similar sets, not both in their sketches: hashes their sketches share, less often with chance MISSED.

    Of the SKETCH least hashes of the union those of both sets are in both sketches; their number is hypergeometric.
    """
    total = np.arange(SKETCH, 64 * SKETCH)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(total) + SKETCH)))])  # of factorials
    union = 5 * total // 9
    both, k = total - union, np.arange(SKETCH + 1)[:, None]

    def ways(n, k):
        good = (k >= 0) & (k <= n)
        k = np.where(good, k, 0)
        return np.where(good, logs[n] - logs[k] - logs[n - k], -np.inf)

    with np.errstate(invalid="ignore"):
        chance = np.exp(ways(both[None, :], k) + ways((union - both)[None, :], SKETCH - k) - ways(union, np.full_like(union, SKETCH))[None, :])
    chance[:, -1] = [math.comb(SKETCH, k) * LEVEL**k * (1 - LEVEL)**(SKETCH - k) for k in range(SKETCH + 1)]  # for all larger ones
    below = np.cumsum(np.nan_to_num(chance), 0)
    return np.concatenate([np.zeros(SKETCH, np.int64), (below <= MISSED).sum(0)])


LEAST_SHARED = least_shared()


def alike(shared: np.ndarray, n: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Which sets of n tokens may be similar by the hashes their sketches share, of which each has `lost` some.

    Sets that fit their sketches are compared exactly, others by the least number similar ones share.
    """
    total, most = n[:, None] + n[None, :], np.maximum(n[:, None], n[None, :])
    need = np.where(most <= SKETCH, (4 * total + 8) // 9, LEAST_SHARED[np.minimum(total, len(LEAST_SHARED) - 1)])
    return (5 * np.minimum(n[:, None], n[None, :]) >= 4 * most) & (shared + np.maximum(lost[:, None], lost[None, :]) >= need)


def sketch_edges(batches):
    """One edge from each set of a bucket to the first it may be similar to, over others."""
    for group in by_group(batches, "leaf"):
        nodes = group["node"].to_pylist()
        first = {n: i for i, n in enumerate(nodes)}
        nodes, at = list(first), list(first.values())
        if len(nodes) < 2:
            continue
        raw = [np.frombuffer(x, np.uint32) for x in group["sketch"].take(at).to_pylist()]
        sketches = [np.unique(x) for x in raw]
        lost = np.array([len(x) - len(y) for x, y in zip(raw, sketches)])
        root = roots(alike(overlaps(sketches), group["n"].to_numpy()[at], lost))
        edge = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in edge], pa.binary()), pa.array([nodes[i] for i in root[edge]], pa.binary())], ["src", "dst"])


def verify(batches):
    """Links of each set within a tile or between two, and the set its links lead to."""
    for group in by_group(batches, "tile"):
        nodes = group["node"].to_pylist()
        first = {n: i for i, n in enumerate(nodes)}
        at = list(first.values())
        nodes, group = list(first), group.take(at)
        n, copies, side, pair = (group[c].to_numpy() for c in ("n", "copies", "side", "pair"))
        # 5 * shared >= 4 * union, in whole numbers
        linked = 9 * overlaps([np.frombuffer(x, np.uint64) for x in group["tokens"].to_pylist()]).astype(np.int64) >= 4 * (n[:, None] + n[None, :])
        np.fill_diagonal(linked, False)
        if pair[0]:  # two tiles: pairs within one are counted where it stands alone
            linked &= side[:, None] != side[None, :]
        links, root = linked @ copies, roots(linked)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array([nodes[i] for i in root], pa.binary())], ["node", "links", "root"])


def similar_sets(docs: DataFrame, key: str, text: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their node; nodes with key and copies; (node, links, root) per tile; nodes of groups
    that take several tiles."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = described(docs, key, text, runs_for(recall))
    nodes = written(sets.where("node IS NOT NULL").groupBy("node").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "buckets", "sketch")]), "join_nodes")
    spread = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = written(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket"), "join_buckets")
    first = written(spread.join(shared, "bucket", "left_semi"), "join_shared")
    keys = nodes.select("node", "key")

    def tokens_for(rows):
        return with_tokens(docs, written(rows.join(keys, "node").select("key", "node", "buckets"), "join_split"), key, text)

    found = written(leaves(first, tokens_for), "join_leaves")
    rows = found.join(nodes.select("node", "n", "sketch"), "node")
    edges = written(rows.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(sketch_edges, "src binary, dst binary").distinct(), "join_edges")
    group = connected_components(edges).withColumnRenamed("component", "group")
    member = written(group.join(nodes.select("node", "key", "n", "copies"), "node"), "join_members")
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_tokens"))
    tiles = F.greatest(F.ceil(F.col("_sets") * 2 / TILE), F.ceil(F.col("_tokens") * 2 / TILE_TOKENS)).cast("int")
    wide = written(size.where((F.col("_sets") > TILE) | (F.col("_tokens") > TILE_TOKENS)).select("group", tiles.alias("_tiles")), "join_wide")
    placed = written(member.join(wide, "group", "left").select("key", "node", "n", "copies", "group", F.coalesce("_tiles", F.lit(1)).alias("_tiles")), "join_placed")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_tiles")).cast("int")
    tiled = (with_tokens(docs, placed, key, text).withColumn("side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
             .withColumn("pair", F.col("side") != F.col("_other"))
             .withColumn("tile", F.xxhash64("group", F.least("side", "_other"), F.greatest("side", "_other"))))
    checked = written(tiled.select("tile", "side", "pair", "node", "n", "copies", "tokens").repartition(parts, "tile").sortWithinPartitions("tile")
                      .mapInArrow(verify, "node binary, links long, root binary"), "join_links")
    wide = placed.where("_tiles > 1").select("node")
    return sets, nodes, checked, wide


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(key, node, root, class_id, n_links, copies) for every document; root names the class.

    class_id: the least key among all documents connected by links of similarity 0.8 or more, itself
    included; n_links: other documents whose set is that similar, copies counted; copies: documents with
    the same set. Texts without words are alone, with a null node. Null keys sort first, repeated rows
    count as copies of one another.
    """
    sets, nodes, checked, wide = similar_sets(docs, key, text, recall)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if wide.isEmpty():
        label = links
    else:  # groups in several tiles: the tiles' own labels are edges between them
        edges = checked.join(wide, "node", "left_semi").select(F.col("node").alias("src"), F.col("root").alias("dst"))
        label = links.join(connected_components(edges), "node", "left").select("node", "links", F.coalesce("component", "root").alias("root"))
    facts = written(nodes.select("node", "key", "copies").join(label, "node", "left").select("node", "key", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "join_facts")
    least = facts.groupBy("root").agg(F.min("key").alias("class_id"))
    facts = written(facts.join(least, "root").select("node", "root", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")), "join_classes")
    return sets.select("key", "node").join(facts, "node", "left").select(
        F.col("key").alias(key), "node", "root", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its own columns: the one of least key, then least node.

    Documents without words all stay. Keys should be unique; where rows repeat a key, the right one is
    found by its text and kept once.
    """
    found = written(joined(docs, key, text).select(F.col(key).alias("key"), "node", "root"), "join_found")
    best = found.where("node IS NOT NULL").groupBy("root").agg(F.min(F.struct("key", "node")).alias("best")).select("best.*")
    rows = found.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("node").isNull()).alias("_blank"))
    keep = written(best.join(rows, best["key"].eqNullSafe(rows["key"])).select(best["key"].alias("_key"), F.col("node").alias("_node"), "_rows"), "join_keep")
    named = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*named).alias("_row"), F.col(key).alias("_mine"), F.col(text).alias("_text"))
    blank = packed.where(F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)) == 0).select("_row")
    wordy = packed.where(F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)) > 0)
    # The keys that go are fewer than those that stay, and the rows stand beside them with their texts.
    stay = keep.where("_rows = 1")
    gone = written(rows.where("_blank < _rows").join(stay, rows["key"].eqNullSafe(stay["_key"]), "left_anti").select(F.col("key").alias("_key")), "join_gone")
    once = wordy.join(gone, F.col("_mine").eqNullSafe(F.col("_key")), "left_anti").select("_row")
    again = keep.where("_rows > 1")
    out = once.unionByName(blank)
    if not again.isEmpty():
        kind = packed.schema["_row"].dataType.simpleString()

        def name(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["_row"], pa.array([node_of(token_set(t)) for t in b["_text"].to_pylist()], pa.binary())], ["_row", "_own"])

        unsure = wordy.join(again.select("_key").distinct(), F.col("_mine").eqNullSafe(F.col("_key"))).select("_row", "_text", "_mine")
        own = unsure.select("_row", "_text").mapInArrow(name, f"_row {kind}, _own binary")
        own = own.withColumn("_mine", F.col(f"_row.`{key}`"))
        match = own.join(again, F.col("_mine").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_node")), "left_semi")
        out = out.unionByName(match.groupBy("_mine", "_own").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(a.n) AND count(*) = any_value(b.n) AS same FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1),
l AS (SELECT a AS doc_id, count(*) AS n_links, count_if(same) AS same FROM p GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (coalesce(same, 0) + 1)::BIGINT AS copies FROM c LEFT JOIN l USING (doc_id)"""
