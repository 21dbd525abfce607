"""Ordered operators that stay balanced when one key owns a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts a whole key in one task. Two shapes avoid it:

* `OrderedRows` cuts only the heavy keys into value ranges of the order column. Folds (running
  sums, maxima, last value) run inside a range and the totals of the earlier ranges of the same
  key are added. Light keys keep one range, so they cost a single window.
* Once a dense position exists, fixed position blocks take the place of the ranges: `halo` for
  windows of bounded reach, `runs` for islands.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from framesift.session import checkpointed

HOT_ROWS = 1_000_000  # rows of one key that one task may sort
HOT_KEYS = 2_000  # a key is cut only above 1/HOT_KEYS of all rows, so at most this many are
RANGE_BITS = 10  # a heavy key is cut into up to 2**RANGE_BITS ranges
SAMPLED = 32  # rows drawn for each range of a heavy key
BUCKET_ROWS = 20_000  # rows of small groups that one Python call gets
SMALL_GROUP = 64  # rows of a group that may be settled together with others
TASK_ROWS = 500_000  # rows of light keys that one task gets
BLOCK = 65_536  # positions per block once rows are numbered


def sort_columns(order: list[str]) -> list[Column]:
    """["a", "-b"] → [a ascending, b descending]."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def _as_tuple(df: DataFrame, order: list[str]) -> Column:
    """The order columns as one struct that grows (first column ascending) or falls (descending) with the order.

    A later column of the other direction is turned round where its type allows it; from the first one
    whose type does not, rows count as ties, which stay in one range.
    """
    down, fields = order[0].startswith("-"), []
    for i, name in enumerate(order):
        x, kind = F.col(name.lstrip("-")), df.schema[name.lstrip("-")].dataType
        if name.startswith("-") != down:
            # Nulls stand first in ascending and last in descending columns; turned round both mean the largest.
            if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                x = F.coalesce(F.bitwise_not(x.cast("long")), F.lit((1 << 63) - 1))
            elif isinstance(kind, (T.FloatType, T.DoubleType)):
                x = F.coalesce(-x.cast("double"), F.lit(float("inf")))
            else:
                break
        fields.append(x.alias(f"o{i}"))
    return F.struct(*fields)


def _range_of(x: Column, cuts: Column) -> Column:
    """Number of cut points below x, by binary search over the sorted array."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(RANGE_BITS))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) < x, F.lit(False)), at + step).otherwise(at),
    )


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a `_range` inside each key; build with `ordered`."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def fold(self, specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> OrderedRows:
        """Add running values per key: name → (sum | max | min | last, column).

        `exclusive` leaves the current row out. NULLs are skipped by every fold.
        """
        frame = (W.unboundedPreceding, -1 if exclusive else W.currentRow)
        ranges = ["_range"] if self.split else []
        inner = W.partitionBy(*self.keys, *ranges).orderBy(*sort_columns(list(self.order)))
        inner = inner.rowsBetween(*frame)
        outer = W.partitionBy(*self.keys).orderBy("_range")
        outer = outer.rowsBetween(W.unboundedPreceding, -1)
        local, totals, carries = {}, [], []
        for name, (how, column) in specs.items():
            local[name] = _fold(how, column).over(inner)
            if how == "last":  # last value of a range = the one with the largest sort key
                rank = F.struct(*[_sortable(c) for c in self.order])
                total = F.max(F.when(column.isNotNull(), F.struct(rank, column.alias("v"))))["v"]
            else:
                total = _fold(how, column)
            totals.append(total.alias(name))
            carries.append(_fold(how, F.col(name)).over(outer).alias(f"_carry_{name}"))
        if "last" in {how for how, _ in specs.values()} and any(
            c.startswith("-") for c in self.order
        ):
            raise ValueError("A last-value fold needs ascending order columns")
        rows = self.df.withColumns(local)
        if not self.split:
            return replace(self, df=rows)
        heavy = self.df.where("_heavy").groupBy(*self.keys, "_range").agg(*totals)
        carry = heavy.select(*self.keys, "_range", *carries)
        joined = rows.join(carry, [*self.keys, "_range"], "left")
        for name, (how, _) in specs.items():
            joined = joined.withColumn(name, _combine(how, F.col(f"_carry_{name}"), F.col(name)))
        return replace(self, df=joined.drop(*[f"_carry_{n}" for n in specs]))

    def rows(self) -> DataFrame:
        return self.df.drop("_range", "_heavy")


def _sortable(name: str) -> Column:
    return F.col(name.lstrip("-"))


def _fold(how: str, column: Column) -> Column:
    if how == "last":
        return F.last(column, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](column)


def _combine(how: str, carry: Column, local: Column) -> Column:
    if how == "sum":
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    if how == "last":
        return F.coalesce(local, carry)
    return {"max": F.greatest, "min": F.least}[how](carry, local)


def light(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """True when no key holds more than max(hot_rows, all rows / HOT_KEYS) rows.

    One aggregate over the key columns; only its largest and total count reach the driver.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    top, total = counts.agg(F.max("_rows"), F.sum("_rows")).first()
    return top is None or top <= max(hot_rows, total // HOT_KEYS)


def settle(df: DataFrame, keys: list[str], hot_rows: int | None) -> int | None:
    """`hot_rows`, or None when a check shows that every key is light.

    Operators that chain several ordered steps over the same keys check once and hand the result
    on: a later step never has more rows per key than a small multiple of the first.
    """
    return None if hot_rows is None or light(df, keys, hot_rows) else hot_rows


def parts_for(df: DataFrame, rows: int, task_rows: int | None = None) -> int:
    """Number of parts that gives a task about `task_rows` of the `rows`, at least the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (task_rows or TASK_ROWS)))


def dealt(df: DataFrame, keys: list[str], rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Deal rows of light keys to as many parts as they need, so that what a task sorts does not grow with the input.

    Later steps over the same keys take the parts over. Where the session's own number will do, rows stay as they are.
    """
    count = parts_for(df, df.count() if rows is None else rows, task_rows)
    return df if count == parts_for(df, 0) else df.repartition(count, *keys)


def ordered(
    df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = HOT_ROWS
) -> OrderedRows:
    """Attach ranges. With only light keys (or `hot_rows=None`: known to be light) there is one
    range per key and no second level.

    Otherwise the rows are written once to the shared folder and keys above max(hot_rows, all rows
    / HOT_KEYS) are cut at sampled splitters, which are tuples of all order columns, so ties of the first
    column spread too. There are at most HOT_KEYS such keys, which is what makes it safe to broadcast
    them. A sample moves the cuts, not the result.
    """
    hot_rows = settle(df, keys, hot_rows)
    if hot_rows is None:
        plain = df.withColumn("_range", F.lit(0)).withColumn("_heavy", F.lit(False))
        return OrderedRows(plain, tuple(keys), tuple(order), split=False)
    df = checkpointed(df)
    x = _as_tuple(df, order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = max(hot_rows, df.count() // HOT_KEYS)
    # A heavy key gets four ranges per share, so there are at most 4 * HOT_KEYS cuts in all.
    pieces = F.least(F.ceil(4 * F.col("_n") / F.lit(share)), F.lit(1 << RANGE_BITS)).cast("int")
    heavy = checkpointed(counts.where(F.col("_n") > share).select(*keys, "_n", pieces.alias("_pieces")))
    chance = F.col("_pieces") * SAMPLED / F.col("_n")
    drawn = F.pmod(F.xxhash64(*[F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]), F.lit(1 << 20)) < chance * (1 << 20)
    sample = df.join(F.broadcast(heavy), keys).where(drawn).select(*keys, "_pieces", x.alias("_x"))
    lists = sample.groupBy(*keys, "_pieces").agg(F.array_sort(F.collect_list("_x")).alias("_s"))
    cuts = lists.select(*keys, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("_pieces") - 1, F.lit(1))), lambda i: F.get(
        "_s", F.floor(i * F.size("_s") / F.col("_pieces")).cast("int")))).alias("_cuts"))
    cuts = heavy.select(*keys).join(cuts, keys, "left").withColumn("_cuts", F.coalesce("_cuts", F.array()))
    sign = -1 if order[0].startswith("-") else 1
    out = df.join(F.broadcast(checkpointed(cuts)), keys, "left")
    out = out.withColumn("_heavy", F.col("_cuts").isNotNull()).withColumn(
        "_range",
        F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.lit(sign) * _range_of(x, F.col("_cuts"))),
    )
    return OrderedRows(out.drop("_cuts"), tuple(keys), tuple(order), split=True)


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "t", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    folded = ordered(df, keys, order, hot_rows).fold({name: ("sum", F.lit(1).cast("long"))})
    return folded.rows().withColumn(name, F.col(name) - 1)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Running folds per key, see `OrderedRows.fold`."""
    return ordered(df, keys, order, hot_rows).fold(specs, exclusive).rows()


def previous(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Value of the row just before: {new name: column}. NULL on the first row of a key."""
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = running(df, keys, order, {"_prev": ("last", row)}, exclusive=True, hot_rows=hot_rows)
    return out.withColumns({n: F.col("_prev")[n] for n in columns}).drop("_prev")


def python_groups(df: DataFrame, keys: list[str]):
    """Group for a Python fold. The explicit partition count keeps adaptive execution from merging
    small shuffles into one partition, where the folds would run one after the other."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys).groupBy(*keys)


def in_buckets(df: DataFrame, keys: list[str], rows: int, fold, schema: str, bucket_rows: int = BUCKET_ROWS, together=None) -> DataFrame:
    """Apply `fold(arrow table of one group)` to every group, many small groups to a Python call.

    Groups are dealt to buckets by hash, about `bucket_rows` of the `rows` each; inside a bucket they are
    told apart by their keys. A group must be of bounded size, as it is held in memory. `together(arrow table,
    first row of each group)`, if given, settles all groups of at most SMALL_GROUP rows in one array step.
    """
    count = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // bucket_rows))

    def each(part: pa.Table) -> pa.Table:
        code = np.zeros(part.num_rows, np.int64)
        for key in keys:
            index = part.column(key).combine_chunks().dictionary_encode().indices
            values = index.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            code = np.unique(code * (values.max(initial=0) + 1) + values, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        part, borders = part.take(pa.array(order)), np.flatnonzero(np.diff(code[order])) + 1
        starts = np.r_[0, borders]
        sizes, done = np.diff(np.r_[starts, part.num_rows]), []
        few = sizes <= SMALL_GROUP if together else np.zeros(len(sizes), bool)
        if few.any():
            done.append(together(part.filter(pa.array(np.repeat(few, sizes))), np.cumsum(sizes[few]) - sizes[few]))
        return pa.concat_tables([*done, *(fold(part.slice(a, n)) for a, n in zip(starts[~few].tolist(), sizes[~few].tolist()))])

    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")).repartition(count, "_bucket")
    return dealt.groupBy("_bucket").applyInArrow(each, schema)


def top_k(df: DataFrame, keys: list[str], order: list[str], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key. The rank filter is pushed below the shuffle as a per-task group limit,
    so a heavy key sends k rows per task, not all of them."""
    w = W.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def halo(df: DataFrame, keys: list[str], pos: str, reach: int, columns, block: int = BLOCK) -> DataFrame:
    """Add window columns that look at most `reach` positions away.

    `columns(window)` gets the ordered window (no frame) and returns {name: column}. Rows within
    `reach` of a block border are also sent to the neighbour block, so every task holds at most
    ``block + 2 * reach`` rows whatever the length of the series.
    """
    if not 0 < reach <= block:
        raise ValueError("Need 0 < reach <= block")
    p = F.col(pos)

    def block_of(x):
        return F.floor(F.greatest(x, F.lit(0)) / F.lit(block)).cast("long")

    homes = F.array_distinct(F.array(block_of(p), block_of(p - reach), block_of(p + reach)))
    spread = df.withColumn("_block", F.explode(homes))
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    out = spread.withColumns(columns(w))
    return out.where(block_of(p) == F.col("_block")).drop("_block")


def runs(
    df: DataFrame, keys: list[str], pos: str, flag: Column, aggs: dict[str, str] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Maximal runs of consecutive positions where `flag` holds → keys, start, stop (exclusive).

    Islands are found per block; only runs that touch a block border (at most two per block) meet
    again to be stitched. `aggs` adds sums over the run: {name: column}.
    """
    aggs = aggs or {}
    hits = df.where(flag).withColumn("_block", F.floor(F.col(pos) / block).cast("long"))
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    hits = hits.withColumn("_island", F.col(pos) - F.row_number().over(w))
    part = hits.groupBy(*keys, "_block", "_island").agg(
        F.min(pos).cast("long").alias("start"),
        (F.max(pos) + 1).cast("long").alias("stop"),
        *[F.sum(c).alias(n) for n, c in aggs.items()],
    )
    touches = (F.col("start") % block == 0) | (F.col("stop") % block == 0)
    part = part.withColumn("_lane", F.when(touches, F.lit(-1)).otherwise(F.col("_block")))
    w = W.partitionBy(*keys, "_lane").orderBy("start")
    fresh = F.coalesce((F.lag("stop").over(w) != F.col("start")).cast("long"), F.lit(1))
    part = part.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    return (
        part.groupBy(*keys, "_lane", "_run")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            *[F.sum(n).alias(n) for n in aggs],
        )
        .drop("_lane", "_run")
    )


def merge_spans(
    df: DataFrame, keys: list[str], a: str, b: str, gap: float = 0.0,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Union of spans per key: a span joins the open one when it starts at most `gap` after its end."""
    spans = ordered(df.select(*keys, a, b), keys, [a, b], hot_rows)
    spans = spans.fold({"_end": ("max", F.col(b))}, exclusive=True)
    opens = F.col("_end").isNull() | (F.col(a) > F.col("_end") + F.lit(float(gap)))
    spans = spans.fold({"_open": ("max", F.when(opens, F.col(a)))})
    merged = spans.rows().groupBy(*keys, "_open").agg(F.max(b).alias(b))
    return merged.withColumnRenamed("_open", a).select(*keys, a, b)
