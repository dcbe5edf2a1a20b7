"""The search for the factor of an attack: the largest value of a function on [0, inf[ in few evaluations.

Steps double as long as each trial beats the best one.  From the first that
doesn't, steps shrink, and each trial leads from the one before it towards the
best place.  The state is five numbers, and ``first``, ``place`` and ``judged``
are all that there is to a search, so that the same rule runs on numbers
and, for all steps of a table at once, on columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a search begins, its first step, by how much steps grow and shrink, and its evaluations.
ORIGIN, STRIDE, GROWTH, SHRINKAGE = 0.0, 1.0, 2.0, 0.8
EVALUATIONS = 16
#: Digits that values are compared by: sums of the same numbers in another order must tie.
DIGITS = 9


class State(NamedTuple):
    """The best place and its value, the last trial's place, the next step's length, and whether steps still grow."""

    best: float
    top: float
    last: float
    stride: float
    growing: bool


def first(value: float) -> State:
    return State(ORIGIN, round(value, DIGITS), ORIGIN, STRIDE, True)


def place(state: State) -> float:
    """Where the next trial is.  A step back that would leave the line is halved until it doesn't."""
    if state.growing:
        return state.best + state.stride
    if state.last < state.best:
        return state.last + state.stride
    back = state.stride
    while back > state.last:
        back /= 2
    return state.last - back


def judged(state: State, trial: float, value: float) -> State:
    value = round(value, DIGITS)
    better = value > state.top
    growing = state.growing and better
    best, top = (trial, value) if better else (state.best, state.top)
    return State(best, top, trial, state.stride * (GROWTH if growing else SHRINKAGE), growing)


def maximum(of: Callable[[float], float], evaluations: int = EVALUATIONS) -> float:
    """The best place found; of equal values the one found first."""
    state = first(of(ORIGIN))
    for _ in range(evaluations - 1):
        trial = place(state)
        state = judged(state, trial, of(trial))
    return state.best


def first_columns() -> dict[str, Column]:
    """The same on columns of the names of State, with ``trial`` and ``value``."""
    return {"best": F.lit(ORIGIN), "top": F.round("value", DIGITS), "last": F.lit(ORIGIN), "stride": F.lit(STRIDE), "growing": F.lit(True)}


def place_column() -> Column:
    """Halving until a step back fits is a division by the smallest fitting power of two."""
    ratio = F.col("stride") / F.col("last")
    power = F.when(ratio <= 1, F.lit(0.0)).otherwise(F.ceil(F.log2(ratio)).cast("double"))
    power = F.when(F.col("stride") / F.pow(F.lit(2.0), power) > F.col("last"), power + 1).when((power > 0) & (F.col("stride") / F.pow(F.lit(2.0), power - 1) <= F.col("last")), power - 1).otherwise(power)
    back = F.when(F.col("last") > 0, F.col("stride") / F.pow(F.lit(2.0), power)).otherwise(F.lit(0.0))
    return F.when(F.col("growing"), F.col("best") + F.col("stride")).when(F.col("last") < F.col("best"), F.col("last") + F.col("stride")).otherwise(F.col("last") - back)


def judged_columns() -> dict[str, Column]:
    value = F.round("value", DIGITS)
    better = value > F.col("top")
    growing = F.col("growing") & better
    return {
        "best": F.when(better, F.col("trial")).otherwise(F.col("best")),
        "top": F.when(better, value).otherwise(F.col("top")),
        "last": F.col("trial"),
        "stride": F.col("stride") * F.when(growing, F.lit(GROWTH)).otherwise(F.lit(SHRINKAGE)),
        "growing": growing,
    }


def maxima(rows: DataFrame, of: Callable[[Column], Column], evaluations: int = EVALUATIONS) -> DataFrame:
    """``rows`` with ``best``, the place found for ``of``, a column made of a trial's place and of columns of ``rows``.

    Every row has a search of its own, and all trials are in one plan, without a shuffle.
    """
    helpers = {*State._fields, "trial", "value"}
    if helpers & set(rows.columns):
        raise ValueError(f"columns of a search can't be named {', '.join(sorted(helpers & set(rows.columns)))}")
    state = rows.withColumn("value", of(F.lit(ORIGIN))).withColumns(first_columns())
    for _ in range(evaluations - 1):
        tried = state.withColumn("trial", place_column())
        state = tried.withColumn("value", of(F.col("trial"))).withColumns(judged_columns())
    return state.select(*rows.columns, "best")
