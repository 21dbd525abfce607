"""JSON-lines manifests and multi-part bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.operators.ordered import dealt, light


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, absent fields are NULL."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def finite(column: str):
    """True unless the value is NaN or infinite; NULL counts as finite (unknown is allowed)."""
    c = F.col(column)
    return c.isNull() | (~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def refuse_non_finite(df: DataFrame) -> DataFrame:
    """Fail the job on the first NaN or infinity, inside the scan that writes the rows."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns(
        {
            c: F.when(finite(c), F.col(c)).otherwise(
                F.raise_error(F.lit(f"NaN or infinity in column {c}")).cast(df.schema[c].dataType)
            )
            for c in floats
        }
    )


def write_manifest(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON-lines sink. NaN and infinity are refused; non-ASCII text is kept as it is."""
    refuse_non_finite(df).write.mode("errorifexists").partitionBy(*(partition_by or [])).json(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    """Selected parts of a bundle stored as `dataset_part=<name>` folders; unselected folders are
    pruned, not read."""
    full = T.StructType([*schema.fields, T.StructField("dataset_part", T.StringType())])
    return spark.read.schema(full).json(path).where(F.col("dataset_part").isin(parts))


def media_in_two_parts(rows: DataFrame, digest: str) -> DataFrame:
    """Hashes that occur in more than one part (must be empty)."""
    found = rows.groupBy(digest).agg(F.min("dataset_part").alias("first_part"),
                                     F.max("dataset_part").alias("last_part"))
    return found.where(F.col("first_part") != F.col("last_part"))


def flatten_records(records: DataFrame) -> DataFrame:
    """Job records with a nested `rows` array → one row per sample."""
    return records.select(F.inline("rows"))


def finalize(jobs: DataFrame, rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gather the rows of finished jobs.

    jobs(key), rows(key, sample_id, …), decisions(sample_id, decision) → (kept rows, jobs without
    any row). A sample without a decision is kept.
    """
    count = rows.count()
    rows = dealt(rows, ["key"], count if light(rows, ["key"]) else 0)
    missing = jobs.join(rows, "key", "left_anti")
    kept = dealt(rows.join(jobs, "key", "left_semi"), ["sample_id"], count)
    kept = kept.join(dealt(decisions, ["sample_id"], count), "sample_id", "left").where(
        F.coalesce("decision", F.lit("keep")) == "keep"
    )
    return kept.drop("decision"), missing
