"""Sparse text, ``label index:value ...`` with indices from 1, as dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(line: Column, width: int) -> Column:
    """A struct of label (1 if it says 1, else 0) and x, ``width`` doubles.

    Indices may come in any order; those beyond ``width`` or below 1 are left
    out, and of one that is there twice the last counts.
    """
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    pair = lambda w, i: F.struct(F.split(w, ":")[0].cast("int").alias("key"), i.alias("at"), F.split(w, ":")[1].cast("double").alias("value"))
    pairs = F.array_sort(F.filter(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), pair), lambda p: p["key"].between(1, width)))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    key = lambda t, i: F.coalesce(F.get(t, i)["key"], F.lit(0))
    once = lambda t: F.filter(t, lambda p, i: key(t, i + 1) != p["key"])
    # The gaps between the pairs are filled; each table is bound once, as the only element of an array.
    dense = lambda t: F.concat(F.flatten(F.transform(t, lambda p, i: F.concat(zeros(p["key"] - key(t, i - 1) - 1), F.array(p["value"])))), zeros(width - key(t, F.size(t) - 1)))
    x = F.transform(F.transform(F.array(pairs), once), dense)[0]
    return F.struct(F.when(F.try_element_at(words, F.lit(1)).cast("double") == 1, 1.0).otherwise(0.0).alias("label"), x.alias("x"))


def read(spark: SparkSession, path: str, width: int = 68) -> DataFrame:
    """(label, x) of text files, one row a line that isn't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(parse(F.col("value"), width).alias("r")).select("r.*")


def normalize(x: Column, mean: float, dev: float) -> Column:
    return F.transform(x, lambda v: (v - mean) / dev)
