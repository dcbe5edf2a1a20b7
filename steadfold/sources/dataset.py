"""Rows as batches: a table in a fixed shuffled order, from which numbered batches are taken again and again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.operators import prefix
from steadfold.operators.training import split_point
from steadfold.sources import scratch
from steadfold.sources.names import unused


def _placed(rows: DataFrame, order: tuple[Column | str, ...], place: str, name: str) -> DataFrame:
    """``rows`` with their places, written once."""
    placed = prefix.numbered(rows, *order, name=place)
    placed.write.parquet(path := scratch.folder(rows.sparkSession, name))
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


class Batches:
    """Batches of ``size`` rows of a table, as many as are asked for; 0 takes all rows as one batch.

    A training cursor runs on over the end (``wraps``), so every batch has
    ``size`` rows; a testing one starts anew there, so the last batch of a
    round may be shorter.  The order is that of ``order``, or of a hash of the
    row and ``seed``.  The rows are written once with their places, and a batch
    reads only those row groups that have some of its places.
    """

    def __init__(self, rows: DataFrame, size: int, *order: Column | str, seed: int = 0, wraps: bool = True, name: str = "rows") -> None:
        order = order or (F.xxhash64(F.lit(seed), *rows.columns),)
        self._take(_placed(rows, order, "rn", name), rows.columns, size, wraps, name)

    def _take(self, placed: DataFrame, columns: list[str], size: int, wraps: bool, name: str) -> None:
        self.placed, self.columns, self.name, self.wraps = placed, columns, name, wraps
        self.n = self.placed.count()
        if not self.n:
            raise ValueError(f"{name} has no rows to take batches from")
        self.size = min(size, self.n) if size and not wraps else size or self.n
        #: Batches of a round of the testing cursor; rows over the size for the training one.
        self.round = math.ceil(self.n / self.size)

    def spread(self, first: int, count: int) -> DataFrame:
        """Batches ``first`` to ``first + count - 1`` as rows with ``slot``, from 0."""
        if not self.wraps:
            slots = F.expr(f"filter(sequence(0L, {count - 1}L), k -> pmod(k + {first}L, {self.round}L) = rn div {self.size})")
            return self.placed.withColumn("slot", F.explode(slots))
        start, whole = first * self.size % self.n, count * self.size
        if start + whole <= self.n:
            near = self.placed.where((F.col("rn") >= start) & (F.col("rn") < start + whole))
            return near.withColumn("slot", F.floor((F.col("rn") - start) / self.size).cast("long"))
        at = F.pmod(F.col("rn") - start, F.lit(self.n))
        again = F.expr(f"sequence(0L, {math.ceil(whole / self.n)}L)")
        placed = self.placed.withColumn("at", F.explode(F.transform(again, lambda k: at + k * self.n))).where(F.col("at") < whole)
        return placed.withColumn("slot", F.floor(F.col("at") / self.size).cast("long")).drop("at")

    def sample(self, number: int) -> DataFrame:
        """One batch."""
        return self.spread(number, 1).select(*self.columns)

    def epoch(self) -> DataFrame:
        """All rows once, with the batch of a round that each is in."""
        return self.placed.select(*self.columns, F.floor(F.col("rn") / self.size).cast("long").alias("batch"))


def datasets(rows: DataFrame, share: float, size: int, test_size: int, *order: Column | str, seed: int = 0) -> tuple[Batches, Batches]:
    """A training and a testing set from one table, cut at a share or a number of its rows; both read the one place where these are written."""
    order = order or (F.xxhash64(F.lit(seed), *rows.columns),)
    (place,) = unused([*rows.columns, "rn"], "place")
    placed = _placed(rows, order, place, "rows")
    at, found = split_point(placed.count(), share), []
    for kept, first, many, wraps, name in ((F.col(place) < at, 0, size, True, "train"), (F.col(place) >= at, at, test_size, False, "test")):
        own = Batches.__new__(Batches)
        rn = F.col(place) - first if first else F.col(place)
        own._take(placed.where(kept).select(*rows.columns, rn.alias("rn")), rows.columns, many, wraps, name)
        found.append(own)
    return found[0], found[1]
