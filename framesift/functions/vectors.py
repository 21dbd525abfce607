"""Array arithmetic for embeddings, kept on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def normalize(v: Column, floor: float = 1e-8) -> Column:
    """v / max(|v|, floor)."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(floor)))


def unit(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps)."""
    return F.transform(v, lambda x: x / (norm(v) + F.lit(eps)))


def distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y + F.lit(eps)) * (x - y + F.lit(eps)))))


def mean_abs_diff(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def vector_sum(column: str, size: int) -> Column:
    """Element-wise sum as an aggregate: `size` partial sums, no collected lists."""
    return F.array(*[F.sum(F.col(column)[i].cast("double")) for i in range(size)])


def vector_mean(column: str, size: int) -> Column:
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(size)])
