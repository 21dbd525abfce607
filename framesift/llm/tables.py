"""Small helpers the operators share: tables on the shared folder, word rules, and folds of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.session import table, workspace

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "512"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Arrow batches are kept small because single texts can be very long."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lost executors cost nothing, and its
    size on disk tells the planner whether a broadcast is safe."""
    path = workspace(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the hash of its parts; the same wherever and however often it runs."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def crc32_sql(text: str) -> str:
    """DuckDB expression for the crc32 of an ASCII text, bit by bit."""
    bit = "list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN {text} = '' THEN [] ELSE {codes} END), lambda a, b: {bit}), 4294967295)"
