"""Trie of conversation prefixes as a node table with perfect-hash slots.

Every prefix gets a digest that adds up hashes of its turns and their places, so it comes from running sums.
Distinct digests are the nodes; that equal digests mean equal prefixes is checked turn by turn. Conversations
are dealt to shards. A shard enumerates its digests, gives each a slot by a minimal perfect hash, scatters the
numbers of its nodes into flat arrays and adds them up through the array of parent slots, deepest first.
Each node's own numbers stand in one shard only, that of its smallest member, whose whole path is there;
so the shards' sums simply add up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.llm.tables import crc32_sql, read, written
from framesift.operators.ordered import HOT_ROWS, running
from framesift.operators.joins import spread_join

SHARD_ROWS = 200_000  # rows of (conversation, depth) a shard holds on average
BLOCK = 16_384  # depths of one conversation that stay together; longer ones are cut and stitched
HOT_CHILDREN = 1_000  # children of one node that a task looks up at once
CHUNK = 65_536  # conversation ids joined into one text
SHARED, FAMILY, SPAN = 8, 5, 9  # the query's rebuild: at most 8 turns of the first of five conversations


# -- sequences ---------------------------------------------------------------------------------------------

def turns_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(c, pos, mark, bytes): turns by position from 0, ordered by turn, null first, then by `mark`, the hash of
    role and text. Null roles and texts are empty; turns without a conversation are left out."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = table.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("_turn"), mark.alias("mark"),
                                                       F.octet_length(text_).cast("long").alias("bytes"))
    placed = running(rows, ["c"], ["_turn", "mark"], {"pos": ("sum", F.lit(1).cast("long"))}, hot_rows=hot_rows)
    return placed.select("c", (F.col("pos") - 1).alias("pos"), "mark", "bytes")


def with_roots(turns: DataFrame) -> DataFrame:
    """Add the textless start, place -10, of every conversation."""
    roots = turns.where("pos = 0").select("c", F.lit(-10).cast("long").alias("pos"), F.lit(b"").alias("mark"), F.lit(0).cast("long").alias("bytes"))
    return turns.unionByName(roots)


def shared_turns(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % SPAN


def rebuilt(turns: DataFrame) -> DataFrame:
    """The query's conversations: the first h turns of the family's first one, then the own ones after h."""
    rows = with_roots(written(turns, "trie_turns"))
    first = F.col("c") - F.col("c") % FAMILY
    own = rows.where((F.col("pos") < 0) | (first == F.col("c")) | (F.col("pos") >= shared_turns(F.col("c"))))
    others = F.explode(F.array(*[F.lit(i).cast("long") for i in range(1 - FAMILY, FAMILY) if i])).alias("_i")
    lent = rows.where((F.col("pos") >= 0) & (F.col("pos") < SHARED) & (first == F.col("c"))).select("*", others)
    lent = lent.withColumns({"_of": F.col("c"), "c": F.col("c") + F.col("_i")}).where((first == F.col("_of")) & (F.col("pos") < shared_turns(F.col("c"))))
    known = rows.where("pos = -10").select("c")
    lent = lent.join(known, "c", "left_semi").select("c", (F.col("pos") - SPAN).alias("pos"), "mark", "bytes")
    return own.unionByName(lent)


# -- prefixes and nodes ------------------------------------------------------------------------------------

def prefixes(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(c, depth, a, b, pa, pb, mark, bytes, last): each prefix of each conversation with its 128-bit digest, that
    of the prefix one shorter, and whether the conversation ends there. `rows` holds the root of each."""
    depth = {"depth": ("sum", F.lit(1).cast("long"))}
    rows = running(rows, ["c"], ["pos"], depth, hot_rows=hot_rows).withColumn("depth", F.col("depth") - 1)
    low = F.lit(0xFFFFFFFF)
    lanes = {}
    for k in (0, 1):
        h = F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "mark", "depth")).otherwise(F.lit(0).cast("long"))
        lanes |= {f"_l{2 * k}": h.bitwiseAND(low), f"_l{2 * k + 1}": F.shiftrightunsigned(h, 32)}
    rows = rows.withColumns(lanes)
    rows = running(rows, ["c"], ["depth"], {f"_s{k}": ("sum", F.col(f"_l{k}")) for k in range(4)}, hot_rows=hot_rows)
    rows = running(rows, ["c"], ["-depth"], {"_after": ("sum", F.lit(1).cast("long"))}, exclusive=True, hot_rows=hot_rows)
    sums = [F.col(f"_s{k}") for k in range(4)]
    shorter = [F.col(f"_s{k}") - F.col(f"_l{k}") for k in range(4)]
    up = F.col("depth") - 1
    return rows.select("c", "depth", F.xxhash64(F.lit(2), *sums, "depth").alias("a"), F.xxhash64(F.lit(3), *sums, "depth").alias("b"),
                       F.xxhash64(F.lit(2), *shorter, up).alias("pa"), F.xxhash64(F.lit(3), *shorter, up).alias("pb"),
                       "mark", "bytes", F.col("_after").isNull().alias("last"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(a, b, pa, pb, owner, depth, n, own, leaf) per distinct prefix: its smallest member, the number of members,
    what they save there, and whether all of them end there.

    Fails if one digest stands for two prefixes: all its rows must have one last turn and one shorter prefix.
    """
    step = F.struct("depth", "pa", "pb", "mark")
    grouped = rows.groupBy("a", "b").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("_bytes"),
                                         F.min(step).alias("_low"), F.max(step).alias("_high"), F.min("last").alias("_leaf"))
    sure = F.when(F.col("_low") == F.col("_high"), F.col("_low.depth")).otherwise(F.raise_error(F.lit("Two prefixes share a digest")).cast("long"))
    return grouped.select("a", "b", "_low.pa", "_low.pb", "owner", sure.alias("depth"), "n", ((F.col("n") - 1) * F.col("_bytes")).alias("own"),
                          F.col("_leaf").cast("long").alias("leaf"))


# -- one shard ---------------------------------------------------------------------------------------------

def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SlotTable:
    """Slots 0 … n-1 for n distinct 128-bit keys, without gaps.

    Level by level, keys that are alone in a table of twice their number take its next ranks and the others
    go on. The keys are kept by slot, so a lookup is verified and a strange key gets -1.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, base, open_ = [], 0, np.arange(len(a))
        while len(open_):
            size = 2 * len(open_) + 6
            at = (_mixed(a[open_], b[open_], len(self.levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            alone = hits == 1
            self.levels.append(np.where(alone, base + np.cumsum(alone) - 1, -1))
            base += int(alone.sum())
            open_ = open_[~alone[at]]
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, ranks in enumerate(self.levels):
            found = ranks[(_mixed(a[open_], b[open_], level) % np.uint64(len(ranks))).astype(np.int64)]
            out[open_] = found
            open_ = open_[found < 0]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self._slots(a, b)
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of one row per distinct key."""
    order = np.lexsort((b, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[fresh]


def shard_sums(part: pa.Table, block: int) -> pa.Table:
    """(a, b, leaves, saved, children) per prefix of the shard that got any.

    Rows of kind 0 are prefixes, of kind 1 nodes with their own numbers, of kind 2 sums from the later blocks
    of a conversation, to be added at the end of this one. Parents are sought within the block only.
    """
    col = {n: part.column(n).to_numpy() for n in ("kind", "depth", "a", "b", "pa", "pb", "leaf", "own")}
    a, b, pa_, pb = (col[n].astype(np.int64).view(np.uint64) for n in ("a", "b", "pa", "pb"))
    one = distinct(a, b)
    table = SlotTable(a[one], b[one])
    n = len(one)
    parent, depth = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    slot = table.find(a[one], b[one])
    depth[slot] = col["depth"][one]
    inside = col["depth"][one] % block != 0
    parent[slot[inside]] = table.find(pa_[one][inside], pb[one][inside])
    leaves, saved, children = (np.zeros(n, np.int64) for _ in range(3))
    own = col["kind"] > 0
    at = table.find(a[own], b[own])
    np.add.at(leaves, at, col["leaf"][own])
    np.add.at(saved, at, col["own"][own])
    node = (col["kind"] == 1) & (col["depth"] > 0)
    up = parent[table.find(a[node], b[node])]
    np.add.at(children, up[up >= 0], 1)
    order = np.argsort(-depth, kind="stable")
    borders = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, borders) if n else []:
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    any_ = (leaves != 0) | (saved != 0) | (children != 0)
    outside = np.flatnonzero(node)[up < 0]  # their parents stand in the block before
    more = np.zeros(len(outside), np.int64)
    keys = {n: np.concatenate((x[any_].view(np.int64), y[outside].view(np.int64))) for n, x, y in (("a", table.a, pa_), ("b", table.b, pb))}
    return pa.table(keys | {"leaves": np.concatenate((leaves[any_], more)), "saved": np.concatenate((saved[any_], more)),
                            "children": np.concatenate((children[any_], more + 1))})


# -- the trie ----------------------------------------------------------------------------------------------

def subtree_sums(rows: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(a, b, leaves, saved, children): parts that add up to each node's sums over its subtree."""
    spark = rows.sparkSession
    count, deepest = rows.agg(F.count(F.lit(1)), F.max("depth")).first()
    none = F.lit(0).cast("long")
    path = rows.select("c", F.lit(0).alias("kind"), "depth", "a", "b", "pa", "pb", none.alias("leaf"), none.alias("own"))
    mine = nodes.select(F.col("owner").alias("c"), F.lit(1).alias("kind"), "depth", "a", "b", "pa", "pb", "leaf", "own")
    every = path.unionByName(mine)
    if deepest is not None and deepest >= block:
        of = F.floor(F.col("depth") / block).cast("long")
        long_ = nodes.groupBy("owner", of.alias("_block")).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")).where("_block > 0")
        later = W.partitionBy("owner").orderBy(F.col("_block").desc())
        ends = long_.select(F.col("owner").alias("c"), (F.col("_block") * block - 1).alias("depth"), F.sum("leaf").over(later).alias("leaf"), F.sum("own").over(later).alias("own"))
        # A block without nodes of its own passes on what lies behind it: only blocks before the first have none.
        gaps = rows.where(F.col("depth") % block == block - 1).select("c", "depth", "a", "b", "pa", "pb")
        first = ends.groupBy("c").agg(F.min_by(F.struct("leaf", "own"), "depth").alias("_all"), F.min("depth").alias("_from"))
        carried = gaps.join(ends, ["c", "depth"], "left").join(first, "c").where("leaf IS NOT NULL OR depth < _from")
        every = every.unionByName(carried.select("c", F.lit(2).alias("kind"), "depth", "a", "b", "pa", "pb",
                                                 F.coalesce("leaf", "_all.leaf").alias("leaf"), F.coalesce("own", "_all.own").alias("own")))
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * count // shard_rows))
    shard = F.pmod(F.xxhash64("c", F.floor(F.col("depth") / block)), F.lit(shards)).cast("int").alias("shard")
    dealt = every.select(shard, "kind", "depth", "a", "b", "pa", "pb", "leaf", "own")
    return dealt.groupBy("shard").applyInArrow(lambda part: shard_sums(part, block), "a long, b long, leaves long, saved long, children long")


def end_hashes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, ends): sha256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Ids are sorted over ranges of (node, id), so a node where very many end spreads; each range joins its ids
    to texts of at most `chunk` ids, and one stream per node hashes these in order, one text in memory at a time.
    """

    def joined(parts):
        key, ids = None, []

        def flushed():
            return pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema=texts)

        texts = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for part in parts:
            for a, b, c in zip(*(part.column(i).to_pylist() for i in range(3))):
                if (a, b) != key or len(ids) >= chunk:
                    if ids:
                        yield flushed()
                    key, ids = (a, b), []
                ids.append(c)
        if ids:
            yield flushed()

    def hashed(parts):
        out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
        key, state = None, None
        for part in parts:
            done = []
            for a, b, ids in zip(*(part.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) != key:
                    if key:
                        done.append({"a": key[0], "b": key[1], "ends": state.hexdigest()})
                    key, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if key:
            yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "ends": state.hexdigest()}], schema=out)

    last = rows.where("last").select("a", "b", "c")
    texts = last.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(joined, "a long, b long, first long, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends string")


def trie(sequences: DataFrame, shard_rows: int = SHARD_ROWS, block: int = BLOCK, chunk: int = CHUNK, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    `sequences` is (c, pos, mark, bytes) with roots, see `turns_of` and `with_roots`. A node is named by its
    smallest member and its depth. Repeated conversations share all their nodes; an empty table has no nodes.
    """
    rows = written(prefixes(sequences, hot_rows), "trie_prefixes")
    nodes = written(nodes_of(rows), "trie_nodes")
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    facts = nodes.select("a", "b", "pa", "pb", "owner", "depth", "n", zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), text.alias("ends"))
    sums = subtree_sums(rows, nodes, shard_rows, block).select("a", "b", *[none.alias(x) for x in ("pa", "pb", "owner", "depth", "n")], "leaves", "saved", "children", text.alias("ends"))
    ends = end_hashes(rows, chunk).select("a", "b", *[none.alias(x) for x in ("pa", "pb", "owner", "depth", "n")], zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "ends")
    whole = facts.unionByName(sums).unionByName(ends).groupBy("a", "b").agg(
        *[F.max(x).alias(x) for x in ("pa", "pb", "owner", "depth", "n", "ends")], *[F.sum(x).alias(x) for x in ("leaves", "saved", "children")])
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_conv_id"))
    named = spread_join(written(whole, "trie_sums"), parents, ["pa", "pb"], spread=["owner", "depth"], hot_rows=HOT_CHILDREN)
    return named.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(read(spark, sf_dir, "conversations"))))


ORACLE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % {FAMILY} AS f, {crc32_sql('c::VARCHAR')} % {SPAN} AS h FROM (SELECT DISTINCT c FROM t)),
l AS (SELECT k.c, t.pos - 100 AS pos, role, text FROM k JOIN t ON t.c = k.f AND t.pos < k.h UNION ALL SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.c AND t.pos >= k.h),
g AS (SELECT k.c, list(sha256(len(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL) AS s, list(strlen(text) ORDER BY pos) FILTER (pos IS NOT NULL) AS b FROM k LEFT JOIN l USING (c) GROUP BY 1),
p AS (SELECT c, coalesce(len(s), 0) AS size, unnest(range(coalesce(len(s), 0) + 1)) AS d, s, b FROM g),
x AS (SELECT c, size, d, sha256(array_to_string(s[1:d], ',')) || d AS k, CASE WHEN d > 0 THEN sha256(array_to_string(s[1:d - 1], ',')) || (d - 1) END AS pk, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS b FROM p),
n AS (SELECT k, any_value(pk) AS pk, any_value(d) AS d, min(c) AS c, count(*) AS n, max(size) = any_value(d) AS leaf, (count(*) - 1) * any_value(b) AS own,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM x GROUP BY k),
u AS (SELECT x.k, count(*) FILTER (n.leaf) AS leaves, sum(own) AS own FROM n JOIN x ON x.c = n.c AND x.d <= n.d GROUP BY 1),
m AS (SELECT pk, count(*) AS m FROM n GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, q.c AS parent_conv_id, n.n AS n_convs, coalesce(m, 0) AS n_children, leaves AS n_leaves, u.own::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.k = n.k LEFT JOIN n q ON q.k = n.pk LEFT JOIN m ON m.pk = n.k"""
