"""Choices of k of n places as columns, by the combinatorial number system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def choose(n: Column, k: Column) -> Column:
    """How many choices there are, as a long; 0 if k is below 0 or above n.  Exact as long as n times the result is a long."""
    small = F.least(k, n - k)
    # Partial products are binomial coefficients themselves, so every division is exact.
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(small, F.lit(1))), F.lit(1).cast("long"), lambda acc, i: _div(acc * (n - small + i), i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(small == 0, F.lit(1).cast("long")).otherwise(product)


def members(n: Column, k: Column, rank: Column) -> Column:
    """The choice of that rank, from 0, in the order of sorted members, as an array of places from 0.

    The choices that have a place come before those that don't, so a place is a
    member if the rank is below how many have it, and else these are passed.
    """

    def step(acc: Column, c: Column) -> Column:
        need = k - F.size(acc["places"])
        having = choose(n - 1 - c, need - 1)
        taken = (need > 0) & (acc["left"] < having)
        places = F.when(taken, F.array_append(acc["places"], c)).otherwise(acc["places"])
        return F.struct(F.when(taken | (need <= 0), acc["left"]).otherwise(acc["left"] - having).alias("left"), places.alias("places"))

    start = F.struct(rank.cast("long").alias("left"), F.array().cast("array<int>").alias("places"))
    return F.when(k <= 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, lambda acc: acc["places"]))
