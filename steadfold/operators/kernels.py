"""The rules on one step's vectors as a numpy matrix, for searches that ask a rule again and again.

They give what the rules of the same names give: see tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Digits that scores, diameters and gaps are ranked by, as in the rules.
DIGITS = 9


def distances(g: np.ndarray) -> np.ndarray:
    """Between all rows, infinity where a distance isn't finite and from a row to itself."""
    with np.errstate(all="ignore"):
        squares = np.stack([((g - row) ** 2).sum(axis=1) for row in g])
    d = np.sqrt(np.where(np.isfinite(squares), squares, np.inf))
    np.fill_diagonal(d, np.inf)
    return d


def ranking(g: np.ndarray, count: int) -> np.ndarray:
    """Rows in the order of the sums of their ``count`` smallest distances; the smaller row first of equal ones."""
    return np.argsort(np.sort(distances(g), axis=1)[:, :count].sum(axis=1).round(DIGITS), kind="stable")


def lower_median(g: np.ndarray) -> np.ndarray:
    middle = np.sort(g, axis=0)[(len(g) - 1) // 2]
    return np.where(np.isnan(g).any(axis=0), np.nan, middle)


def around_median(g: np.ndarray, drop: int) -> np.ndarray:
    """The mean of each coordinate's values closest to its lower median, without ``drop`` of them."""
    order = np.argsort(np.abs(g - lower_median(g)).round(DIGITS), axis=0, kind="stable")[: len(g) - drop]
    return np.take_along_axis(g, order, axis=0).mean(axis=0)


def average(g: np.ndarray, f: int) -> np.ndarray:
    return g.mean(axis=0)


def median(g: np.ndarray, f: int) -> np.ndarray:
    return lower_median(g)


def krum(g: np.ndarray, f: int) -> np.ndarray:
    return g[np.sort(ranking(g, len(g) - f - 1)[: len(g) - f - 2])].mean(axis=0)


def bulyan(g: np.ndarray, f: int) -> np.ndarray:
    most = len(g) - f - 2
    order = ranking(g, most)
    windows = [g[order[i : i + most - i]].mean(axis=0) for i in range(len(g) - 2 * f - 2)]
    return around_median(np.stack(windows), 2 * f)


def brute(g: np.ndarray, f: int) -> np.ndarray:
    """NaN where every subset has a distance that isn't finite; either of the two rows farthest apart goes, f levels deep."""
    d, n = distances(g).round(DIGITS), len(g)
    np.fill_diagonal(d, 0)
    level: set[tuple[int, ...]] = {()}
    best: tuple[float, list[int]] | None = None
    for k in range(f + 1):
        below = set()
        for gone in level:
            left = [i for i in range(n) if i not in gone]
            kept = left[: n - f]
            now = (float(d[np.ix_(kept, kept)].max()), kept)
            if np.isfinite(now[0]) and (best is None or now < best):
                best = now
            if k < f:
                x, y = np.unravel_index(d[np.ix_(left, left)].argmax(), (len(left), len(left)))
                below |= {tuple(sorted((*gone, left[x]))), tuple(sorted((*gone, left[y])))}
        level = below
    return g[best[1]].mean(axis=0) if best else np.full(g.shape[1], np.nan)


KERNELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"average": average, "median": median, "krum": krum, "bulyan": bulyan, "brute": brute}
