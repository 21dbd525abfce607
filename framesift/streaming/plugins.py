"""Places where a caller's own function goes in: per value, per group, and one row to many."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction


def with_reader(reader: Callable[[object], float]) -> Callable[[Column], Column]:
    """Wrap a caller's reader (value → number) as an Arrow-batched column function."""

    @F.pandas_udf(T.DoubleType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else float(reader(v)))

    return apply


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Caller's group function; keys must name bounded groups (a clip, one hour of a source)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


class ClipWindows:
    """Table function: (rows, size, stride) → windows with a flush-right tail."""

    def eval(self, n: int, size: int, stride: int):
        if n <= size:
            yield 0, n
            return
        at = 0
        while at + size <= n:
            yield at, at + size
            at += stride
        if at - stride + size < n:
            yield n - size, n


def register_windows(spark: SparkSession) -> UserDefinedTableFunction:
    return spark.udtf.register("clip_windows", F.udtf(ClipWindows, returnType="start bigint, stop bigint"))
