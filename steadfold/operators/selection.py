"""The n-th smallest of very many values, without bringing a key's values together.

Doubles are taken as whole numbers in the same order, and a key's answer is
narrowed down by BITS bits a round: values that have what is known so far are
counted by their next bits, at most 2^BITS counts a key, which are added up
before they are shuffled.  Values are written once and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfold.sources import scratch
from steadfold.sources.names import unused

BITS = 13


def ordered_bits(x: Column) -> Column:
    """A double as a long in the same order; both zeros are one, and NaN comes last.  Null stays null."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x, F.lit(0.0)) + F.lit(0.0)).cast("long")
    return F.when(x.isNull(), F.lit(None)).when(bits < 0, F.bitwise_not(bits).bitwiseXOR(F.lit(-(1 << 63)))).otherwise(bits)


def from_bits(bits: Column) -> Column:
    """The double that ``ordered_bits`` has made the long from."""
    plain = F.when(bits < 0, F.bitwise_not(bits.bitwiseXOR(F.lit(-(1 << 63))))).otherwise(bits)
    return F.when(bits.isNotNull(), F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.coalesce(plain, F.lit(0).cast("long"))).cast("double"))


def nth(rows: DataFrame, value: str, rank: Column, *keys: str) -> DataFrame:
    """Of each key: ``value``, the one of the rank, and any_nan, n (the values that aren't null).

    ``rank`` is a column of n, from 0.  Nulls aren't counted, NaN is the largest
    of all; a key whose rank isn't below n, or that has only nulls, has a null
    value.  Null keys are one key.  An empty table gives an empty result.
    """
    spark, taken = rows.sparkSession, [*keys, value]
    bits, known, low, count, digit, before, want, *own = unused(taken, "bits", "known", "low", "count", "digit", "before", "want", *(f"own_{k}" for k in range(len(keys))))
    kept = rows.select(*keys, ordered_bits(F.col(value).cast("double")).alias(bits), F.isnan(value).alias("any_nan"))
    kept.write.parquet(path := scratch.folder(spark, "values"))
    kept = spark.read.schema(kept.schema).parquet(path)

    sizes = kept.groupBy(*keys).agg(F.count(bits).alias("n"), F.coalesce(F.max("any_nan"), F.lit(False)).alias("any_nan"))
    state = sizes.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), "n", F.col("any_nan").alias("nan"), rank.cast("long").alias(want), F.lit(0).cast("long").alias(known))
    # From the top down; the first round's part has the sign, so its order is shifted by it.
    cuts = list(range(64, 0, -BITS))
    for top in cuts:
        low_bits = max(0, top - BITS)
        state.write.parquet(at := scratch.folder(spark, "ranks"))
        state = spark.read.schema(state.schema).parquet(at)
        same = F.lit(True)
        for k, o in zip(keys, own, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(o))
        shifted = F.col(bits).bitwiseXOR(F.lit(-(1 << 63)))
        if top < 64:
            same = same & (F.shiftrightunsigned(shifted, top) == F.col(known))
        part = F.shiftrightunsigned(shifted, low_bits).bitwiseAND((1 << (top - low_bits)) - 1)
        counts = kept.join(state.select(*own, known), same).where(F.col(bits).isNotNull()).groupBy(*own, part.alias(digit)).agg(F.count("*").alias(count))
        order = Window.partitionBy(*own).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn(before, F.coalesce(F.sum(count).over(order), F.lit(0)))
        renamed = placed.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), digit, before, count)
        same = F.lit(True)
        for k, o in zip(keys, own, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(o))
        hit = same & (F.col(want) >= F.col(before)) & (F.col(want) < F.col(before) + F.col(count))
        found = state.join(renamed, hit, "left")
        next_known = F.shiftleft(F.col(known), top - low_bits).bitwiseOR(F.col(digit))
        state = found.select(*own, "n", "nan", (F.col(want) - F.col(before)).alias(want), next_known.alias(known))
    plain = F.col(known).bitwiseXOR(F.lit(-(1 << 63)))
    return state.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), from_bits(plain).alias(value), F.col("nan").alias("any_nan"), "n")
