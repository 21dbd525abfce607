"""Donors of a row: counting and picking among the rows of its group, without listing pairs.

A donor has at least a certain size and does not overlap the row in time when both come from one source.
Counting is two-dimensional (size or place, and time); picking finds the k-th remaining row in a given order.
Groups up to `leaf` rows are settled as arrays in one step. Larger ones are walked as a tree over the order:
at each level the donors in the left half are counted with running sums, whose heavy keys are cut, and
every row that asks goes left or right, until the half it needs is one leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.hashing import stable_int
from framesift.operators.joins import spread_join
from framesift.operators.ordered import HOT_ROWS, in_buckets, positions, running
from framesift.session import checkpointed

LEAF_BITS = 11  # 2**LEAF_BITS rows of a group are compared in one step
BY_HASH, NEXT, BEFORE, LAST, GIVEN = range(5)  # which remaining row an ask wants
FIELDS = ["_id", "_p", "_size", "_source", "_a", "_b"]


# -- counting in two dimensions ----------------------------------------------------------------------------

def dominance(points: DataFrame, asks: DataFrame, keys: list[str], closed: bool, bits: int = LEAF_BITS,
              hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(_ask, _count): points of the ask's key with u >= the ask's u and v < its v (<= if `closed`).

    All are ranked by falling u. An ask counts the points before it: those of its own block of ranks in
    one array step, those further ahead once per level of halving, in which it stands in a right
    half and they in the left one, by a running count over v. Rows grow by one per level above the block.
    """
    both = points.select(*keys, "u", "v", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_ask")).unionByName(
        asks.select(*keys, "u", "v", F.lit(1).alias("_kind"), "_ask"))
    ranked = checkpointed(positions(both, keys, ["-u", "_kind"], "_r", hot_rows))
    here = ranked.withColumn("_block", F.shiftright("_r", bits))

    def inside(part: pa.Table) -> pa.Table:
        r, v, kind = (part.column(n).to_numpy(zero_copy_only=False) for n in ("_r", "v", "_kind"))
        p, q = kind == 0, np.flatnonzero(kind == 1)
        found = np.zeros(len(q), np.int64)
        for at in range(0, len(q), 256):
            i = q[at:at + 256, None]
            ahead = v[p][None] <= v[i] if closed else v[p][None] < v[i]
            found[at:at + 256] = (ahead & (r[p][None] < r[i])).sum(1)
        return pa.table({"_ask": part.column("_ask").take(pa.array(q)), "_count": found})

    top, total = ranked.agg(F.coalesce(F.max("_r"), F.lit(0)), F.count(F.lit(1))).first()
    counts = in_buckets(here.select(*keys, "_block", "_r", "v", "_kind", "_ask"), [*keys, "_block"], total, inside, "_ask long, _count long")
    if top >> bits:
        levels = F.explode(F.sequence(F.lit(bits), F.lit(top.bit_length() - 1))).alias("_level")
        tree = ranked.select("*", levels).withColumn("_right", F.expr("shiftright(_r, _level) & 1"))
        tree = tree.where("_right = _kind").withColumn("_block", F.expr("shiftright(_r, _level + 1)"))
        tie = F.col("_kind") if closed else 1 - F.col("_kind")
        ran = running(tree.withColumn("_tie", tie), [*keys, "_level", "_block"], ["v", "_tie"],
                      {"_count": ("sum", (F.col("_kind") == 0).cast("long"))}, hot_rows=hot_rows)
        counts = counts.unionByName(ran.where("_kind = 1").select("_ask", "_count"))
    return counts.groupBy("_ask").agg(F.sum("_count").alias("_count"))


def remaining(rows: DataFrame, asks: DataFrame, keys: list[str], low: str, bits: int, hot_rows: int | None) -> DataFrame:
    """Add `_count` to asks: rows of the key with _<u> at least the ask's `low`, without the asking row and those
    of its source that overlap it. `rows` and `asks` carry `_u`, the value that `low` bounds."""
    marks = rows.select(*keys, F.col("_u").alias("_v"), F.lit(0).alias("_later"), F.lit(1).cast("long").alias("_one"), F.lit(None).cast("long").alias("_ask"))
    wants = asks.select(*keys, F.col(low).alias("_v"), F.lit(1).alias("_later"), F.lit(0).cast("long").alias("_one"), "_ask")
    fits = running(marks.unionByName(wants), keys, ["-_v", "_later"], {"_fit": ("sum", F.col("_one"))}, hot_rows=hot_rows)
    fits = fits.where("_later = 1").select("_ask", "_fit")
    # A row with a span overlaps those of its source that begin before its end, less those that end before its start.
    timed, by = F.col("_a") < F.col("_b"), [*keys, "_source"]
    spans, seen = rows.where(timed), asks.where(timed)
    begun = dominance(spans.select(*by, F.col("_u").alias("u"), F.col("_a").alias("v")), seen.select(*by, F.col(low).alias("u"), F.col("_b").alias("v"), "_ask"),
                      by, False, bits, hot_rows)
    ended = dominance(spans.select(*by, F.col("_u").alias("u"), F.col("_b").alias("v")), seen.select(*by, F.col(low).alias("u"), F.col("_a").alias("v"), "_ask"),
                      by, True, bits, hot_rows)
    signed = begun.unionByName(ended.withColumn("_count", -F.col("_count"))).groupBy("_ask").agg(F.sum("_count").alias("_over"))
    itself = (~F.coalesce(timed, F.lit(False)) & F.coalesce(F.col("_own"), F.lit(False))).cast("long")  # without a span it is not among the overlapping
    out = asks.join(fits, "_ask").join(signed, "_ask", "left")
    return out.withColumn("_count", F.col("_fit") - F.coalesce("_over", F.lit(0)) - itself).drop("_fit", "_over")


# -- picking -----------------------------------------------------------------------------------------------

def _leaf(rows: pa.Table) -> pa.Table:
    """Answers of one leaf: rows of kind -1 are candidates, the others ask."""
    col = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in ("_kind", "_p", "_size", "_a", "_b", "_x", "_h", "_k")}
    col["_code"] = rows.column("_source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(col["_kind"] < 0)
    mine = mine[np.argsort(col["_p"][mine])]
    asks = np.flatnonzero(col["_kind"] >= 0)
    count, chosen = np.zeros(len(asks), np.int64), np.full(len(asks), -1, np.int64)
    p, size, a, b, code = (col[n][mine][None] for n in ("_p", "_size", "_a", "_b", "_code"))
    for at in range(0, len(asks), 256):
        i = asks[at:at + 256]
        me = {n: col[n][i][:, None] for n in col}
        over = (code == me["_code"]) & (a < me["_b"]) & (me["_a"] < b) & (a < b) & (me["_a"] < me["_b"])
        free = (size >= me["_x"]) & ~over & (p != me["_p"])
        pool = free.sum(1)
        below = (free & (p < me["_p"])).sum(1)
        k = _wanted(col, i, pool, below)
        good = (k >= 0) & (k < pool)
        ranks = np.cumsum(free, 1)
        where = (ranks <= k[:, None]).sum(1)
        count[at:at + 256], chosen[at:at + 256] = pool, np.where(good, mine[np.where(good, where, 0)] if len(mine) else -1, -1)
    taken = pa.array(np.where(chosen >= 0, chosen, 0), mask=chosen < 0)
    return pa.table({"_ask": rows.column("_ask").take(pa.array(asks)), "_pool": count, "_pick": rows.column("_id").take(taken), "_pick_size": rows.column("_size").take(taken)})


def _leaves(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """Answers of many small leaves, sorted by leaf, in one step over all (ask, candidate) pairs of a leaf."""
    col = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in ("_kind", "_p", "_size", "_a", "_b", "_x", "_h", "_k")}
    code = rows.column("_source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    leaf = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
    mine, asks = np.flatnonzero(col["_kind"] < 0), np.flatnonzero(col["_kind"] >= 0)
    mine = mine[np.lexsort((col["_p"][mine], leaf[mine]))]
    first, last = np.searchsorted(leaf[mine], leaf[asks]), np.searchsorted(leaf[mine], leaf[asks], "right")
    size = last - first
    ends = np.cumsum(size)
    ask = np.repeat(np.arange(len(asks)), size)
    i, j = asks[ask], mine[np.arange(len(ask)) - np.repeat(ends - size, size) + np.repeat(first, size)]
    a, b, p = col["_a"], col["_b"], col["_p"]
    over = (code[j] == code[i]) & (a[j] < b[i]) & (a[i] < b[j]) & (a[j] < b[j]) & (a[i] < b[i])
    free = (col["_size"][j] >= col["_x"][i]) & ~over & (p[j] != p[i])
    pool = np.bincount(ask[free], minlength=len(asks))
    below = np.bincount(ask[free & (p[j] < p[i])], minlength=len(asks))
    k = _wanted(col, asks, pool, below)
    hits = j[free]
    good = (k >= 0) & (k < pool)
    taken = pa.array(hits[np.where(good, np.cumsum(pool) - pool + k, 0)] if len(hits) else np.zeros(len(asks), np.int64), mask=~good)
    return pa.table({"_ask": rows.column("_ask").take(pa.array(asks)), "_pool": pool.astype(np.int64), "_pick": rows.column("_id").take(taken), "_pick_size": rows.column("_size").take(taken)})


def _wanted(col: dict, i: np.ndarray, pool: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Which of its remaining rows each ask wants."""
    return np.select([col["_kind"][i] == w for w in (BY_HASH, NEXT, BEFORE, LAST)],
                     [np.where(pool > 0, col["_h"][i] % np.maximum(pool, 1), -1), below, below - 1, pool - 1], col["_k"][i]).astype(np.int64)


def picks(rows: DataFrame, asks: DataFrame, keys: list[str], bits: int = LEAF_BITS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(_ask, _pool, _pick, _pick_size) per ask.

    `rows` are the candidates of each group with FIELDS, numbered by _p in the wanted order; `asks` have the same
    of the asking row and _ask, _kind (which remaining row), _x (least size) and _h (a hash, for BY_HASH).
    """
    asks = asks.withColumn("_k", F.lit(None).cast("long")).withColumn("_node", F.lit(0).cast("long"))
    wide = rows.where(F.col("_p") == (1 << bits)).select(*keys, F.lit(True).alias("_wide"))
    top, total = rows.agg(F.coalesce(F.max("_p"), F.lit(0)), F.count(F.lit(1))).first()
    known = None
    if top >> bits:
        rows = checkpointed(spread_join(rows, wide, keys, hot_rows=hot_rows).withColumn("_wide", F.coalesce("_wide", F.lit(False))))
        asks = checkpointed(spread_join(asks, wide, keys, hot_rows=hot_rows).withColumn("_wide", F.coalesce("_wide", F.lit(False))))
        large = rows.where("_wide")
        open_ = asks.where("_wide").withColumn("_own", F.lit(True))
        pools = remaining(large.withColumn("_u", F.col("_size")), open_, keys, "_x", bits, hot_rows)
        below = remaining(large.withColumn("_u", -F.col("_p").cast("double")), open_.where(f"_kind IN ({NEXT}, {BEFORE})")
                          .withColumns({"_low": (1 - F.col("_p")).cast("double"), "_own": F.lit(False)}), keys, "_low", bits, hot_rows)
        pools = pools.withColumnRenamed("_count", "_pool").join(below.select("_ask", F.col("_count").alias("_below")), "_ask", "left")
        k = (F.when(F.col("_kind") == BY_HASH, F.when(F.col("_pool") > 0, F.col("_h") % F.greatest("_pool", F.lit(1)))).when(F.col("_kind") == NEXT, F.col("_below"))
             .when(F.col("_kind") == BEFORE, F.col("_below") - 1).otherwise(F.col("_pool") - 1))
        open_ = checkpointed(pools.withColumn("_k", F.coalesce(k, F.lit(-1))).drop("_below"))
        known = open_.select("_ask", F.col("_pool").alias("_all"))
        for level in reversed(range(top.bit_length() - bits)):
            shift = bits + level
            half = large.withColumns({"_node": F.shiftright("_p", shift + 1), "_u": F.col("_size")}).where(F.expr(f"shiftright(_p, {shift}) & 1") == 0)
            own = (F.shiftright("_p", shift) == F.col("_node") * 2)
            left = remaining(half, open_.withColumn("_own", own), [*keys, "_node"], "_x", bits, hot_rows)
            right = F.col("_k") >= F.col("_count")
            open_ = checkpointed(left.withColumns({"_node": F.col("_node") * 2 + right.cast("long"), "_k": F.when(right, F.col("_k") - F.col("_count")).otherwise(F.col("_k"))})
                                 .drop("_count"))
        asks = asks.where("NOT _wide").drop("_wide").unionByName(open_.withColumn("_kind", F.lit(GIVEN)).select(*[c for c in asks.columns if c != "_wide"]))
    leaf = [*keys, "_node", *FIELDS]
    mine = rows.withColumns({"_node": F.shiftright("_p", bits), "_kind": F.lit(-1)}).select(*leaf, "_kind")
    met = mine.unionByName(asks.select(*leaf, "_kind", "_ask", "_x", "_h", "_k"), allowMissingColumns=True).na.fill({"_k": -1, "_h": 0})
    ident = rows.schema["_id"].dataType.simpleString()
    out = in_buckets(met, [*keys, "_node"], 2 * total, _leaf, f"_ask long, _pool long, _pick {ident}, _pick_size double", together=_leaves)
    if known is not None:
        out = out.join(known, "_ask", "left").withColumn("_pool", F.coalesce("_all", "_pool")).drop("_all")
    return out


def _fields(df: DataFrame, keys: list[str], order: list[str], ident: str, size: str, source: str, start: str, end: str, hot_rows: int | None) -> DataFrame:
    """Candidates with FIELDS, numbered in the given order; rows without a size take no part."""
    known = df.where(F.col(size).isNotNull()).select(*keys, F.col(ident).alias("_id"), F.col(size).cast("double").alias("_size"), F.col(source).alias("_source"),
                                                     F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_b"))
    return checkpointed(positions(known, keys, order, "_p", hot_rows).withColumn("_ask", F.monotonically_increasing_id()))


def donors(df: DataFrame, keys: list[str], ident: str, size: str, source: str, start: str, end: str, shorter: float, seed: str,
           bits: int = LEAF_BITS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, ident, pool, donor): how many donors each row has, and one of them.

    A donor is another row of the group, at most `shorter` smaller (plus 1e-6), from another source or not
    overlapping in time. In order of `ident`, a hash of seed and ident picks it. A row whose span is null or
    empty overlaps nothing; a row without a size is no donor and has none. Idents are distinct.
    """
    rows = _fields(df, keys, ["_id"], ident, size, source, start, end, hot_rows)
    asks = rows.withColumns({"_kind": F.lit(BY_HASH), "_x": F.col("_size") - F.lit(float(shorter)) - F.lit(1e-6),
                             "_h": stable_int(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string"))).cast("long")})
    found = rows.select(*keys, "_id", "_ask").join(picks(rows.drop("_ask"), asks, keys, bits, hot_rows), "_ask")
    return _back(df, found.select("_id", F.col("_pool").alias("pool"), F.col("_pick").alias("donor")), keys, ident).select(
        *keys, ident, F.coalesce("pool", F.lit(0).cast("long")).alias("pool"), "donor")


def nearest_donor(df: DataFrame, keys: list[str], ident: str, size: str, source: str, start: str, end: str, shorter: float,
                  bits: int = LEAF_BITS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(keys, ident, donor, error, cut): the donor of the closest size, the longer one on a tie; where no donor
    is at most `shorter` smaller, the longest row that does not overlap (cut is true), null without any.

    In order of (size, ident) the closest are the remaining rows just before and after the asking one.
    """
    rows = _fields(df, keys, ["_size", "_id"], ident, size, source, start, end, hot_rows)
    kinds = F.explode(F.array(*[F.lit(k) for k in (NEXT, BEFORE, LAST)])).alias("_kind")
    asks = rows.select("*", kinds).withColumns({"_row": F.col("_ask"), "_ask": F.col("_ask") * 4 + F.col("_kind"), "_x": F.lit(float("-inf")), "_h": F.lit(0).cast("long")})
    found = picks(rows.drop("_ask"), asks.drop("_row"), keys, bits, hot_rows).withColumn("_row", F.shiftright("_ask", 2))
    which = F.expr("_ask & 3")
    sides = found.groupBy("_row").agg(*[F.max(F.when((which == k) & F.col("_pick").isNotNull(), F.struct("_pick", "_pick_size"))).alias(n)
                                        for n, k in (("up", NEXT), ("down", BEFORE), ("top", LAST))])
    whole = rows.select("_id", "_size", F.col("_ask").alias("_row")).join(sides, "_row")
    up, down = F.col("up._pick_size") - F.col("_size"), F.when(F.col("down._pick_size") >= F.col("_size") - F.lit(float(shorter)) - F.lit(1e-6), F.col("_size") - F.col("down._pick_size"))
    fit = F.when(up.isNotNull() & (down.isNull() | (up <= down)), F.col("up._pick")).when(down.isNotNull(), F.col("down._pick"))
    best = whole.select("_id", F.coalesce(fit, F.col("top._pick")).alias("donor"), F.when(fit.isNotNull(), F.least(up, down)).alias("error"), fit.isNull().alias("cut"))
    return _back(df, best, keys, ident).select(*keys, ident, "donor", "error", F.coalesce("cut", F.lit(True)).alias("cut"))


def _back(df: DataFrame, found: DataFrame, keys: list[str], ident: str) -> DataFrame:
    return df.select(*keys, ident).join(found.withColumnRenamed("_id", ident), ident, "left")
