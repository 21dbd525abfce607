"""The list of source URLs, a hand-edited CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted spellings of "many speakers".
MANY = ["n", "nhieu", "nhiều", "many", "multi", "2+"]


def read_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejects). `#` lines and rows without URL are skipped; a `speakers` value that is
    not 1, 2 or a spelling of n goes to `rejects` with its text."""
    raw = spark.read.schema("url string, speakers string, note string").option("comment", "#").csv(path)
    url = F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), "^﻿", ""))
    raw = raw.select(
        url.alias("url"), F.lower(F.trim(F.coalesce("speakers", F.lit("")))).alias("given"),
        F.trim(F.coalesce("note", F.lit(""))).alias("note"),
    ).where((F.col("url") != "") & ~((F.col("url") == "url") & (F.col("given") == "speakers")))
    speakers = F.when(F.col("given").isin("1", "2"), F.col("given")).when(
        F.col("given").isin(MANY), F.lit("n")
    )
    rows = raw.withColumn("speakers", speakers)
    good = rows.where("speakers IS NOT NULL").select("url", "speakers", "note")
    bad = rows.where("speakers IS NULL").select(
        "url", F.concat(F.lit("speakers must be 1, 2 or n: "), F.col("given")).alias("reason")
    )
    return good, bad


def register_inputs(known: DataFrame, incoming: DataFrame, key: str, attribute: str):
    """(rows to insert, conflicts). A known key keeps its row; another attribute is a conflict."""
    fresh = incoming.join(known, key, "left_anti")
    old = known.select(key, F.col(attribute).alias("known_value"))
    clash = incoming.join(old, key).where(~F.col(attribute).eqNullSafe(F.col("known_value")))
    return fresh, clash
