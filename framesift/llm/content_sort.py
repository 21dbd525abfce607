"""Exact duplicates by content sort: sampled splitters, an external sort, and full comparisons of neighbours.

Rows are range-partitioned on the leading bytes of the normalised text (and its hash, so that texts with one
beginning spread too) at splitters that Spark samples. Each range is sorted, which puts equal texts next to each
other, and neighbours are compared in full. A text that holds a large share of the rows is dealt to several
ranges; only the first row of each such part meets again, to be compared and added up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.llm.tables import read, written

HEAD = 32  # leading bytes that splitters are made of, so that the sampled ones stay small on the driver
HOT_ROWS = 256  # rows of one text that are never worth splitting


def as_is(text: Column) -> Column:
    return text


def folded(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def marked(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise: Callable[[Column], Column] = as_is,
           keep: str = "smallest", carry: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_row, _key, keep_id, group_size, kept, text_sha256) for every row of `docs`, dropped ones too.

    `_row` is the whole row (or its columns `carry`), so columns with clashing names survive. Rows are equal when their normalised texts
    are the same bytes; a null text counts as empty. Of equal rows the one with the smallest (or largest, see
    `keep`) key stays. A null key stays only if its group has no other; of rows that repeat a key within a
    group one stays, the first by the hash of its columns. An empty table gives an empty result.

    A text with more than max(hot_rows, rows / (2 x shuffle partitions)) rows counts as hot; there are at most
    2 x shuffle partitions of them, so their hashes are safe to broadcast. Each is dealt to as many parts as it
    has such shares. A hash only says what to split; whether texts are equal is decided on the bytes.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession

    def ends_last(name: str) -> Column:
        return F.col(name).asc_nulls_last() if keep == "smallest" else F.col(name).desc_nulls_last()

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    body = normalise(F.coalesce(F.col("_row").getField(text), F.lit(""))).cast("binary")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(whole.alias("_row"), F.col(key).alias("_key"), F.xxhash64(*plain).alias("_tie"))
    rows = rows.withColumns({"_hash": F.xxhash64(body), "_head": F.substring(body, 1, HEAD)})

    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.greatest(F.lit(max(1, hot_rows)), F.floor(F.lit(docs.count()) / (2 * ranges)))
    hot = written(counts.where(F.col("_n") > share).select("_hash", F.ceil(F.col("_n") / share).cast("int").alias("_parts")), "dedup_hot")
    split = not hot.isEmpty()
    if split:
        rows = rows.join(F.broadcast(hot), "_hash", "left")
        part = F.pmod(F.xxhash64("_key", F.spark_partition_id()), F.col("_parts")).cast("int")
        rows = rows.withColumn("_part", F.coalesce(part, F.lit(-1))).drop("_parts")

    cut = ["_head", "_hash", *(["_part"] if split else [])]
    ranged = rows.repartitionByRange(*cut).withColumn("_body", body)
    # The range partitioning already serves this window: nothing is shuffled again, and one sort serves all of it.
    equal = W.partitionBy(*cut, "_body").orderBy(ends_last("_key"), "_tie")
    group = equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    best = F.min if keep == "smallest" else F.max
    sorted_ = ranged.withColumns({
        "keep_id": best("_key").over(group), "group_size": F.count(F.lit(1)).over(group),
        "kept": F.row_number().over(equal) == 1,
        "_row": F.struct(*[F.col("_row").getField(c).alias(c) for c in (docs.columns if carry is None else carry)]),
    }).withColumn("text_sha256", F.sha2("_body", 256))
    out = ["_row", "_key", "keep_id", "group_size", "kept", "text_sha256"]
    if not split:
        return sorted_.select(*out)

    # Hot texts: the first row of each part stands for it; at most 4 x shuffle partitions such rows.
    parts = written(sorted_.withColumn("_body", F.when((F.col("_part") >= 0) & F.col("kept"), F.col("_body")))
                    .select(*out, "_part", "_body"), "dedup_parts")
    same = W.partitionBy("_body")
    total = parts.where("_body IS NOT NULL").withColumns({
        "_keep": best("keep_id").over(same), "_size": F.sum("group_size").over(same),
        "_stays": F.row_number().over(same.orderBy(ends_last("keep_id"), "_part")) == 1,
    }).select("text_sha256", "_part", "_keep", "_size", "_stays")
    mended = parts.where("_part >= 0").join(total, ["text_sha256", "_part"]).select(
        "_row", "_key", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("kept") & F.col("_stays")).alias("kept"), "text_sha256")
    return parts.where("_part < 0").select(*out).unionByName(mended)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; options as in `marked`."""
    return marked(docs, **options).where("kept").select("_row.*")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return marked(docs, keep="largest", carry=["doc_id"]).select(F.col("_key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
