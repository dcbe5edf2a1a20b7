"""Parameter checks, and bounds on the ratio of deviation to norm under which a rule is known to hold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule was asked for with parameters that it isn't defined for."""


#: Checks of rules that were registered: each takes (n, f, m) and raises RuleError, or says what is wrong, or nothing.
CHECKS: dict[str, Callable[[int, int, int | None], str | None] | None] = {}


def check(rule: str, n: int, f: int, m: int | None = None) -> None:
    """Raise RuleError unless ``rule`` is known and defined for n vectors, f of them arbitrary, and m to select."""
    for name, value in {"n": n, "f": f, "m": m}.items():
        if value is not None and (isinstance(value, bool) or not isinstance(value, int)):
            raise RuleError(f"{rule}: {name} must be an integer, not {value!r}")
    if n < 1:
        raise RuleError(f"{rule}: at least one vector is needed")
    if rule in CHECKS:
        own = CHECKS[rule]
        if own and (wrong := own(n, f, m)):
            raise RuleError(f"{rule}: {wrong}")
        return
    if rule in ("average", "median"):
        return
    if rule not in ("krum", "bulyan", "brute"):
        raise RuleError(f"no rule is named {rule}")
    least = {"krum": 2 * f + 3, "bulyan": 4 * f + 3, "brute": 2 * f + 1}[rule]
    if f < 1:
        raise RuleError(f"{rule}: f must be 1 or more, not {f}")
    if n < least:
        raise RuleError(f"{rule}: f = {f} needs {least} vectors or more, not {n}")
    if rule in ("krum", "bulyan") and m is not None and not 1 <= m <= n - f - 2:
        raise RuleError(f"{rule}: m must be within 1 and {n - f - 2}, not {m}")


def _neighbours(n: Column, f: Column) -> Column:
    return n - f + f * (n + f * (n - f - 2) - 2) / (n - 2 * f - 2)


#: Bounds as columns of n and f, by rule; average has none.  The formulas are fixed values.
BOUNDS: dict[str, Callable[[Column, Column], Column]] = {
    "median": lambda n, f: 1 / F.sqrt(n - f),
    "krum": lambda n, f: 1 / F.sqrt(2 * _neighbours(n, f)),
    "bulyan": lambda n, f: 1 / F.sqrt(2 * _neighbours(n, f)),
    "brute": lambda n, f: (n - f) / (math.sqrt(8) * f),
}


def bound(rule: str, n: Column, f: Column) -> Column:
    """The bound of a rule, as a column; a rule without one is an error."""
    if rule not in BOUNDS:
        raise RuleError(f"{rule} has no bound")
    return BOUNDS[rule](n.cast("double"), f.cast("double"))
