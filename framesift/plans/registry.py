"""Named queries: a Spark builder plus, where SQL can say it, the DuckDB statement to compare with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    row: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, row: str, sql: str | None = None):
    """Register `build(spark, sf_dir)` under `name` for inventory row(s) `row`."""

    def keep(build):
        if name in REGISTRY:
            raise ValueError(f"Query {name} registered twice")
        REGISTRY[name] = Query(name, row, build, sql)
        return build

    return keep
