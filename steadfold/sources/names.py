"""Names for helper columns that no column of a table has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Of each wanted name the first of itself, itself_1, itself_2 ... that isn't taken, whatever the case."""
    seen, found = {c.lower() for c in taken}, []
    for name in wanted:
        tries = (f"{name}_{k}" if k else name for k in range(len(seen) + 1))
        found.append(next(x for x in tries if x.lower() not in seen))
        seen.add(found[-1].lower())
    return found
