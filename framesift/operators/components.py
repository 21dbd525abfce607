"""Connected groups of speakers, sources and hashes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators.joins import spread_join
from framesift.operators.ordered import parts_for
from framesift.session import workspace

SMALL = 4096  # edges that one task settles at the end
HELD = 1_000_000  # edges a task holds at once


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder, compressed, and continue from the written rows."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identity_edges(rows: DataFrame, ident: str, columns: dict[str, str]) -> DataFrame:
    """(src, dst): every row node with its non-empty identity nodes. columns: {column: namespace}."""
    nodes = F.array(*[
        F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{space}:"), F.col(c).cast("string")))
        for c, space in columns.items()])
    pairs = rows.select(F.concat(F.lit("row:"), F.col(ident).cast("string")).alias("src"), F.explode(nodes).alias("dst"))
    return pairs.where("dst IS NOT NULL")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 200) -> DataFrame:
    """(node, component) with component = the smallest node of the group.

    Works on 64-bit hashes of the nodes, hashed anew in the rare case that two nodes share one. The number
    of parts follows that of the edges, so a task's share stays the same.
    """
    ends = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node")))
    for seed in range(8):
        def number(c, seed=seed):
            return F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), c))

        names = written(ends.select(number("node").alias("id"), "node").distinct(), "component_names")
        known = names.where("id IS NOT NULL")
        if known.select("id").distinct().count() == known.count():
            break
    else:
        raise RuntimeError("Nodes share their hashes with every seed")
    found = number_components(edges.select(number(src).alias("src"), number(dst).alias("dst")), rounds=rounds)
    parts = parts_for(names, names.count())
    rows = names.repartition(parts, "id").join(found.withColumnRenamed("node", "id").repartition(parts, "id"), "id", "left")
    out = least_of_group(rows.select("node", "root"))
    return out if parts == parts_for(names, 0) else out.repartition(parts, "node")


def least_of_group(rows: DataFrame) -> DataFrame:
    """(node, component) from (node, root): the smallest node of each root."""
    least = rows.groupBy("root").agg(F.min("node").alias("component"))
    return spread_join(rows, least, ["root"]).select("node", F.coalesce("component", "node").alias("component"))


def number_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 200) -> DataFrame:
    """(node, root) for whole numbers: all nodes of a group have the same root, one of them. Null ends are left out.

    The edges of a task are replaced by a star for each group they form. Then every node takes the smallest
    node it knows for its name, and edges go on between names, fewer in each round; the order of the numbers
    changes from round to round, so that no order of the input is slow. Names of the rounds are then followed back.
    """
    turn = random.Random(1)
    ends = edges.select(F.coalesce(src, dst).alias("a"), F.coalesce(dst, src).alias("b")).where("a IS NOT NULL")
    work, levels, mask = written(stars(ends), "component_edges"), [], 0
    for _ in range(rounds):
        count = work.count()
        if count <= SMALL:
            labels = stars(work.coalesce(1)) if count else work
            break
        parts = parts_for(work, 2 * count)
        near = work.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("v"))
        both = work.select(F.col("a").alias("u"), F.col("b").alias("v")).union(near.select("u", "v"))
        least = written(both.repartition(parts, "u").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component_names")
        levels.append((mask, least))
        one = work.repartition(parts, "a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
        two = one.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).where("a <> b")
        last, mask = mask, turn.getrandbits(63)
        work = written(stars(two.select(*[F.col(c).bitwiseXOR(F.lit(last ^ mask)).alias(c) for c in ("a", "b")])), "component_edges")
    else:
        raise RuntimeError(f"Components did not settle in {rounds} rounds")
    labels = labels.select(*[F.col(c).bitwiseXOR(F.lit(mask)).alias(n) for c, n in (("a", "node"), ("b", "root"))])
    for mask, least in reversed(levels):
        down = least.select(*[F.col(c).bitwiseXOR(F.lit(mask)).alias(c) for c in ("u", "m")])
        known = labels.select(F.col("node").alias("m"), "root")
        labels = written(spread_join(down, known, ["m"]).select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root")), "component_labels")
    return labels if levels else written(labels, "component_labels")


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the edges of a task with the smallest node they connect it with there, itself included."""

    def settle(batches):
        held, rows = [], 0
        for batch in batches:
            held.append([batch[c].to_numpy() for c in ("a", "b")])
            rows += batch.num_rows
            if rows >= HELD:
                held = [spanned(*map(np.concatenate, zip(*held)))]
                rows = len(held[0][0])
                if 2 * rows > HELD:
                    yield from _batches(*held[0])
                    held, rows = [], 0
        if rows:
            yield from _batches(*spanned(*map(np.concatenate, zip(*held))))

    return edges.mapInArrow(settle, "a long, b long")


def _batches(a: np.ndarray, b: np.ndarray, size: int = 65_536):
    for lo in range(0, len(a), size):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo:lo + size]), pa.array(b[lo:lo + size])], ["a", "b"])


def spanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of both, and for each the smallest it is connected with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        x, y = label[x], label[y]
        rest = x != y
        x, y = x[rest], y[rest]
    return ids, ids[label]


def leaking_components(rows: DataFrame, component: str, split: str) -> DataFrame:
    """Components whose rows sit in more than one split (must be empty)."""
    ends = rows.groupBy(component).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("n"))
    return ends.where("first_split <> last_split")
