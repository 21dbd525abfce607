"""Choices that depend only on (seed, id), so any partitioning gives the same answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the three splits in twentieths (60 / 15 / 25 %).
TRAIN_BELOW, VALIDATION_BELOW, SHARES = 12, 15, 20


def stable_int(text: Column) -> Column:
    """First 8 hex digits of the SHA-256 of a text, as a number."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 8), 16, 10).cast("long")


def sha1_byte(text: Column, index: int) -> Column:
    """Byte `index` of the SHA-1 digest of a text."""
    return F.conv(F.substring(F.sha1(text.cast("string")), 2 * index + 1, 2), 16, 10).cast("long")


def split_of(key: Column) -> Column:
    part = stable_int(key) % SHARES
    return (
        F.when(part < TRAIN_BELOW, F.lit("train"))
        .when(part < VALIDATION_BELOW, F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def pick(options: Column, text: Column) -> Column:
    """One element of an array, chosen by the hash of a text; NULL for an empty array."""
    return F.get(options, (stable_int(text) % F.greatest(F.size(options), F.lit(1))).cast("int"))
