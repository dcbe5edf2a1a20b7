"""Places and running sums in a total order, without bringing all rows into one task.

Rows are cut into ranges, each of which is one task's; what a range adds to a
sum is one row, and these few rows alone are summed in order.  Bounds of ranges
are sampled, so a plan that is run twice cuts elsewhere; the rows are therefore
written once, with their range and their place in it, and the sums and the
result are read from what is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfold.sources import scratch
from steadfold.sources.names import unused


def _ranges(rows: DataFrame, part: str, at: str, order: tuple[Column | str, ...]) -> DataFrame:
    """``rows``, written with their range and their place in it."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ordered.write.parquet(path := scratch.folder(spark))
    placed = spark.read.schema(ordered.schema).parquet(path)
    return placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))


def numbered(rows: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """``rows`` with ``rn`` (or ``name``) from 0 in a total order.

    All columns of ``rows`` are returned as they are; one that is named as
    ``name`` is replaced.  Nulls in the order come first, ties and repeated
    rows get different places, and an empty table gives an empty result.
    """
    part, at, base = unused(rows.columns, "part", "at", "base")
    placed = _ranges(rows, part, at, order)
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base)
    found = placed.join(F.broadcast(counts.select(part, before)), part)
    return found.withColumn(name, F.col(base) + F.col(at)).drop(part, at, base)


def running(rows: DataFrame, sums: dict[str, str], *order: Column | str) -> DataFrame:
    """``rows`` with, under each new name, the sum of a column over the rows before it in a total order; 0 for the first.

    Of ties any may come first.  Nulls add nothing; an empty table gives an
    empty result.
    """
    part, at, *bases = unused([*rows.columns, *sums], "part", "at", *(f"base_{k}" for k in range(len(sums))))
    placed = _ranges(rows, part, at, order)
    totals = placed.groupBy(part).agg(*(F.sum(c).alias(c) for c in dict.fromkeys(sums.values())))
    every = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    known = totals.select(part, *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(b) for b, c in zip(bases, sums.values(), strict=True)))
    own = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(known), part)
    for (name, column), base in zip(sums.items(), bases, strict=True):
        found = found.withColumn(name, F.col(base) + F.coalesce(F.sum(column).over(own), F.lit(0)))
    return found.drop(part, at, *bases)


def within(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with their number from 0 among the rows that share all of ``keys``, however many these are.

    Nulls are equal to each other.  Any of a group's rows may come first.
    """
    tie, rn, first, *own = unused([*rows.columns, name], "tie", "rn", "first", *(f"own_{k}" for k in keys))
    placed = numbered(rows.withColumn(tie, F.monotonically_increasing_id()), *keys, tie, name=rn).drop(tie)
    firsts = placed.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.min(rn).alias(first))
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return placed.join(firsts, same).withColumn(name, F.col(rn) - F.col(first)).drop(rn, first, *own)


#: Copies of a row that are made from one piece of it.
PIECE = 1 << 16


def multiplied(rows: DataFrame, times: Column, name: str, piece: int = PIECE) -> DataFrame:
    """``rows``, each as often as ``times`` says, with the copy's number from 0 under ``name``; none where that is 0 or null.

    A row is cut into pieces of so many copies, and these are dealt to all
    tasks, so that one row with very many copies isn't one task's.
    """
    often, part = unused([*rows.columns, name], "often", "part")
    counted = rows.withColumn(often, times.cast("long")).where(F.col(often) > 0)
    pieces = counted.withColumn(part, F.explode(F.expr(f"sequence(0L, (`{often}` - 1) div {piece})")))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks, F.xxhash64(*rows.columns, part))
    return dealt.withColumn(name, F.explode(F.expr(f"sequence(`{part}` * {piece}, least(`{often}`, (`{part}` + 1) * {piece}) - 1)"))).drop(often, part)
