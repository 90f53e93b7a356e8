"""Column expressions over ``ARRAY<DOUBLE>`` vectors (JVM side, no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: str | Column) -> Column:
    """The vector as ``ARRAY<DOUBLE>``; float arrays are widened."""
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    """A constant vector, folded by the optimizer into one literal."""
    return F.lit([float(v) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u + v)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def scale(a: Column, s: float) -> Column:
    return F.transform(a, lambda v: v * F.lit(float(s)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


def fit_length(a: Column, d: int) -> Column:
    """Cut a vector to ``d`` entries, or fill it up with zeros."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(d) - F.size(a), F.lit(0)))
    return F.slice(F.concat(a, zeros), 1, d)
