"""Formulas as small trees, which are columns and have derivatives that are formulas again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[..., "Formula"]


class Formula:
    """A number made of columns: ``column`` gives it, ``slope`` its derivative by a variable.

    ``parts`` are what it is made of, ``make`` makes a column of theirs, and
    ``rule`` the derivative of the parts and their derivatives.  A formula
    without a rule doesn't change with any variable.
    """

    def __init__(self, make: Callable[..., Column], rule: Rule | None = None, *parts: Formula) -> None:
        self.make, self.rule, self.parts = make, rule, parts

    def column(self) -> Column:
        return self.make(*(p.column() for p in self.parts))

    def slope(self, by: Formula) -> Formula:
        if self is by:
            return number(1)
        if self.rule is None or not self.has(by):
            return number(0)
        return self.rule(*self.parts, *(p.slope(by) for p in self.parts))

    def has(self, other: Formula) -> bool:
        return self is other or any(p.has(other) for p in self.parts)

    def __add__(self, other: object) -> Formula:
        return Formula(lambda a, b: a + b, lambda a, b, da, db: da + db, self, formula(other))

    def __sub__(self, other: object) -> Formula:
        return Formula(lambda a, b: a - b, lambda a, b, da, db: da - db, self, formula(other))

    def __mul__(self, other: object) -> Formula:
        return Formula(lambda a, b: a * b, lambda a, b, da, db: da * b + a * db, self, formula(other))

    def __truediv__(self, other: object) -> Formula:
        return Formula(lambda a, b: a / b, lambda a, b, da, db: (da * b - a * db) / (b * b), self, formula(other))

    def __neg__(self) -> Formula:
        return Formula(lambda a: -a, lambda a, da: -da, self)

    def __radd__(self, other: object) -> Formula:
        return formula(other) + self

    def __rsub__(self, other: object) -> Formula:
        return formula(other) - self

    def __rmul__(self, other: object) -> Formula:
        return formula(other) * self


def known(value: Column) -> Formula:
    """A column that no variable is part of; also what a variable is made from."""
    return Formula(lambda: value)


def number(value: float) -> Formula:
    return Formula(lambda: F.lit(float(value)))


def formula(x: object) -> Formula:
    return x if isinstance(x, Formula) else known(x) if isinstance(x, Column) else number(x)


def exp(x: Formula) -> Formula:
    return Formula(F.exp, lambda x, dx: exp(x) * dx, x)


def log(x: Formula, least: float | None = None) -> Formula:
    """The logarithm; with ``least`` never below it, and flat where it would be."""
    if least is None:
        return Formula(F.ln, lambda x, dx: dx / x, x)
    low = F.lit(float(least))
    bounded = lambda c: F.when(c <= 0, low).otherwise(F.greatest(low, F.ln(F.when(c > 0, c))))
    return Formula(bounded, lambda x, dx: where(lambda c: c > F.exp(low), x, dx / x, number(0)), x)


def log1p(x: Formula) -> Formula:
    return Formula(F.log1p, lambda x, dx: dx / (1 + x), x)


def sigmoid(x: Formula) -> Formula:
    return Formula(lambda c: 1 / (1 + F.exp(-c)), lambda x, dx: sigmoid(x) * (1 - sigmoid(x)) * dx, x)


def absolute(x: Formula) -> Formula:
    """Its slope at zero is zero."""
    return Formula(F.abs, lambda x, dx: Formula(F.signum, None, x) * dx, x)


def where(test: Callable[[Column], Column], on: Formula, yes: Formula, no: Formula) -> Formula:
    """``yes`` where the test of ``on`` holds, else ``no``."""
    return Formula(lambda c, a, b: F.when(test(c), a).otherwise(b), lambda on, a, b, _, da, db: where(test, on, da, db), on, yes, no)


def picked(among: Sequence[Formula], at: Column) -> Formula:
    """The one that a column says, counted from 0."""
    n = len(among)
    return Formula(lambda *c: F.get(F.array(*c), at.cast("int")), lambda *both: picked(both[n:], at), *among)


def log_sum_exp(among: Sequence[Formula]) -> Formula:
    """The logarithm of the sum of exponentials, without overflow."""
    n = len(among)

    def make(*c: Column) -> Column:
        top = F.greatest(*c) if n > 1 else c[0]
        return top + F.ln(reduce(lambda a, b: a + b, (F.exp(x - top) for x in c)))

    def rule(*both: Formula) -> Formula:
        whole = log_sum_exp(both[:n])
        return reduce(lambda a, b: a + b, (exp(x - whole) * dx for x, dx in zip(both[:n], both[n:], strict=True)))

    return Formula(make, rule, *among)
