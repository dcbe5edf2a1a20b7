"""Column functions on vectors, arrays of doubles, that stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def total(x: Column) -> Column:
    """The sum of an array, folded in order, so that it doesn't depend on partitioning."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l1_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))


def largest(a: Column) -> Column:
    """The largest absolute coordinate; NaN counts as the largest."""
    return F.array_max(F.transform(a, F.abs))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def finite_or_inf(x: Column) -> Column:
    """NaN and either infinity as plus infinity: a distance that can't be trusted is the largest."""
    return F.when(F.isnan(x) | (F.abs(x) == INF), F.lit(INF)).otherwise(x)


def clipped(a: Column, limit: float) -> Column:
    """Vectors longer than ``limit`` are shortened to it."""
    return F.when(norm(a) > limit, scaled(a, F.lit(float(limit)) / norm(a))).otherwise(a)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def flattened(*parts: Column) -> Column:
    """Parameter blocks as one vector."""
    return F.flatten(F.array(*parts))


def unflattened(a: Column, sizes: list[int]) -> list[Column]:
    """The blocks of a vector; what it lacks is filled with zeros."""
    starts = [1 + sum(sizes[:k]) for k in range(len(sizes))]
    filled = F.concat(a, F.array_repeat(F.lit(0.0), sum(sizes)))
    return [F.slice(filled, s, n) for s, n in zip(starts, sizes, strict=True)]


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for results; adding zero makes a negative zero plain."""
    return F.round(x, digits) + F.lit(0.0)
