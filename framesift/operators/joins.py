"""Joins the curation rules need beyond plain equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framesift.operators.ordered import (
    BLOCK, HOT_KEYS, HOT_ROWS, halo, running,
)
from framesift.session import checkpointed

NULL_PARTS = 1_000  # rows without a key match nothing; a left join deals them to so many parts


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, a: str, b: str,
               width: float, closed: bool = False) -> DataFrame:
    """Points inside [a, b) (or [a, b]) of the same key.

    Spans are listed in every bucket of `width` they touch, so the join is an equi join on
    (keys, bucket) plus a residual; `width` should be near the usual span length.
    """
    w = F.lit(float(width))
    left = points.withColumn("_bucket", F.floor(F.col(pos) / w).cast("long"))
    buckets = F.sequence(F.floor(F.col(a) / w).cast("long"), F.floor(F.col(b) / w).cast("long"))
    right = spans.where(F.col(a) <= F.col(b)).withColumn("_bucket", F.explode(buckets))
    inside = (F.col(pos) >= F.col(a)) & ((F.col(pos) <= F.col(b)) if closed else (F.col(pos) < F.col(b)))
    return left.join(right, [*keys, "_bucket"]).where(inside).drop("_bucket")


def spread_join(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "left",
                spread: list[str] | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Join one row per key (`totals`) to many, also where one key holds a large share of them.

    Keys with more than share = max(hot_rows, all rows / HOT_KEYS) rows are hot; there are at most
    HOT_KEYS, so their list is safe to broadcast. A hot key's rows are dealt to one part per share by
    a hash of `spread` (all columns by default), and its total is listed once per part, at most
    2 · HOT_KEYS rows in all. Neither side is read twice. `how` is left or inner; with only light
    keys, or `hot_rows=None` (known to be light), it is a plain join.
    """
    if how not in ("left", "inner"):
        raise ValueError("spread_join is left or inner")
    if hot_rows is None:
        return rows.join(totals, keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    share = max(hot_rows, (total or 0) // HOT_KEYS, 1)
    if (top or 0) <= share:
        return rows.join(totals, keys, how)
    named = [F.col(k).isNotNull() for k in keys]
    known = named[0]
    for one in named[1:]:
        known = known & one
    heavy = checkpointed(counts.where((F.col("_n") > share) & known).select(
        *keys, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_parts")))
    columns = spread or [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    parts = F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(F.lit(NULL_PARTS))
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), parts).cast("int")).drop("_parts")
    right = totals.join(F.broadcast(heavy), keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def with_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add {name: one plain aggregate of the key} to every row whose key is known.

    With only light keys (`hot_rows=None`) the totals are taken over the rows as they stand sorted by key, so a
    task sorts them once; else they are aggregated and joined, hot keys spread.
    """
    if hot_rows is not None:
        return spread_join(rows, rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys, "inner", hot_rows=hot_rows)
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows.withColumns({n: c.over(W.partitionBy(*keys)) for n, c in totals.items()})


def as_of(grid: DataFrame, rows: DataFrame, keys: list[str], pos: str, columns: list[str],
          hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Last row at or before each grid point, as one ordered pass over grid ∪ rows.

    Both sides have `keys` and `pos`; a grid point before the first row gets NULLs.
    """
    packed = F.struct(*columns)
    both = rows.select(*keys, pos, packed.alias("_row"), F.lit(0).alias("_grid")).unionByName(
        grid.select(*keys, pos, F.lit(1).alias("_grid")), allowMissingColumns=True)
    filled = running(both, keys, [pos, "_grid"], {"_last": ("last", F.col("_row"))}, hot_rows=hot_rows)
    return filled.where("_grid = 1").select(
        *keys, pos, *[F.col("_last")[c].alias(c) for c in columns])


def lag_sums(df: DataFrame, keys: list[str], pos: str, terms: dict, valid: str, carried: list[str],
             max_lag: int, block: int = BLOCK, least: int = 10) -> DataFrame:
    """(keys, lag, pairs, n, one sum per term) for every lag in ±max_lag.

    Row t is paired with row t − lag of the same series; each `term(row, other)` is summed where
    both rows are valid. The partners come from lag windows, not from a join; each row lists its
    2·max_lag + 1 partners inside the task and partial sums are combined before the shuffle. With
    fewer than `least` overlapping rows, or no valid pair, the sums are NULL.
    """
    lags = range(-max_lag, max_lag + 1)

    def shifted(w):
        row = F.struct(valid, *carried)
        return {f"_o{i}": F.lag(row, d).over(w) for i, d in enumerate(lags)}

    wide = halo(df.select(*keys, pos, valid, *carried), keys, pos, max_lag, shifted, block)
    partners = F.explode(F.array(*[
        F.struct(F.lit(d).cast("long").alias("lag"), F.col(f"_o{i}").alias("o")) for i, d in enumerate(lags)])).alias("_p")
    long = wide.select(*keys, valid, *carried, partners).select(
        *keys, F.col("_p.lag").alias("lag"), valid, *carried, F.col("_p.o").alias("_o"))
    both = F.col(valid) & F.col("_o")[valid]
    row, other = {c: F.col(c) for c in carried}, {c: F.col("_o")[c] for c in carried}
    out = long.groupBy(*keys, "lag").agg(
        F.count("_o").alias("pairs"), F.count(F.when(both, F.lit(1))).alias("n"),
        *[F.sum(F.when(both, term(row, other))).alias(name) for name, term in terms.items()])
    enough = (F.col("pairs") >= least) & (F.col("n") > 0)
    return out.withColumns({t: F.when(enough, F.col(t)) for t in terms})


def reference_of(df: DataFrame, group: list[str], ident: str, source: str, size: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Reference row per row: same group, other row; another source first, then longest, then id.

    Two summaries per group are enough: the longest row of the two best sources, and the two
    longest rows (for groups with one source). Both come from partial maxima.
    """
    key = F.struct(F.col(size).alias("size"), (-F.col(ident)).alias("neg"))
    per_source = df.groupBy(*group, source).agg(F.max(key).alias("best"))

    def two_best(rows, value, name):
        # top two by two maxima: a partial aggregate keeps two entries, never the whole group
        first = rows.groupBy(*group).agg(F.max(value).alias("a"))
        rest = spread_join(rows, first, group, "inner", hot_rows=hot_rows).where(value != F.col("a"))
        second = rest.groupBy(*group).agg(F.max(value).alias("b"))
        return first.join(second, group, "left").select(
            *group, F.col("a").alias(f"{name}1"), F.col("b").alias(f"{name}2"))

    ranked = F.struct(F.col("best.size").alias("size"), F.col("best.neg").alias("neg"),
                      F.col(source).alias("source"))
    sources = two_best(per_source, ranked, "s")
    rows = two_best(df, key, "r")
    both = sources.join(rows, group)
    out = spread_join(df, both, group, "inner", [ident], hot_rows)
    mine = F.col("s1.source") == F.col(source)
    other_source = F.when(mine, -F.col("s2.neg")).otherwise(-F.col("s1.neg"))
    other_row = F.when(-F.col("r1.neg") == F.col(ident), -F.col("r2.neg")).otherwise(-F.col("r1.neg"))
    return out.select(*group, ident, F.coalesce(other_source, other_row, F.col(ident)).alias("reference"))


def merge_sessions(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two job-record tables (key, status, body) with a verdict per key.

    A retryable record yields to a finished one; two finished records must agree.
    """
    a, b = mine.alias("a"), theirs.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    retry_a, retry_b = F.col("a.status") == "retry", F.col("b.status") == "retry"
    verdict = (
        F.when(F.col(f"a.{key}").isNull(), F.lit("theirs"))
        .when(F.col(f"b.{key}").isNull(), F.lit("mine"))
        .when(retry_a & ~retry_b, F.lit("theirs"))
        .when(retry_b, F.lit("mine"))
        .when(F.col("a.body").eqNullSafe(F.col("b.body")), F.lit("same"))
        .otherwise(F.lit("conflict")))
    take = verdict == "theirs"
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), verdict.alias("verdict"),
        F.when(take, F.col("b.status")).otherwise(F.col("a.status")).alias("status"),
        F.when(take, F.col("b.body")).otherwise(F.col("a.body")).alias("body"))


def composite_lookup(df: DataFrame, keys: list[str], wanted: Column, columns: dict[str, str]) -> DataFrame:
    """Attach columns of the row matching `wanted` under the same composite key (one per key)."""
    target = df.where(wanted).groupBy(*keys).agg(
        *[F.first(c).alias(n) for n, c in columns.items()])
    return df.join(target, keys, "left")
