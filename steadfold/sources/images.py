"""Arrays as portable image files: grey (P5) or black and white (P4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pnm(values: np.ndarray, width: int, bits: bool = False) -> bytes:
    """The bytes of an image of rows of ``width`` values, scaled between the smallest and the largest.

    ``bits`` sets what is above the middle to black, eight places a byte, as
    the format has it.  A single value is black; one that isn't finite counts
    as the smallest.
    """
    x = np.asarray(values, float).reshape(-1, width)
    finite = np.isfinite(x)
    lo, hi = (x[finite].min(), x[finite].max()) if finite.any() else (0.0, 0.0)
    scaled = np.where(finite, (x - lo) / ((hi - lo) or 1.0), 0.0)
    kind, body, depth = ("P4", np.packbits(scaled > 0.5, axis=1), "") if bits else ("P5", np.floor(scaled * 255).astype(np.uint8), "255\n")
    return f"{kind}\n{width} {len(x)}\n{depth}".encode() + body.tobytes()


def images(rows: DataFrame, width: int, bits: bool = False) -> DataFrame:
    """(id, x) -> (id, image): files as binary values, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "image": [pnm(x, width, bits) for x in part["x"]]})

    return rows.select("id", "x").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, image binary")


def flipped(x: Column, width: int) -> Column:
    """An image of rows of ``width`` values, left side right."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1), lambda k: F.reverse(F.slice(x, k * width + 1, F.lit(width))))
    return F.when(F.size(x) >= width, F.flatten(rows)).otherwise(x)


def flipped_at_random(x: Column, width: int, *key: Column | str, seed: int = 0) -> Column:
    """Half of the images flipped, chosen by a hash of ``key`` and a seed, so that reruns agree."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2)) == 1, flipped(x, width)).otherwise(x)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder and its folders as (path, width, height, depth, x, error).

    Grey (P5) and black and white (P4) files; ``x`` has the values row by row,
    from 0 to ``depth``, two bytes each where that is over 255, and black as 1.
    All is done in columns.  A header may have comments and any white space.
    A file that isn't such an image has an ``error`` and nulls, one that is cut
    or has more than its header says too; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return decoded(files)


#: What stands between the parts of a header; comments go to the end of their line.
_GAP = r"(?:\s|#[^\n]*\n)+"


def decoded(files: DataFrame) -> DataFrame:
    """(path, content) -> (path, width, height, depth, x, error); see ``read``."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    grey, bits = rf"(?s)^(P5){_GAP}(\d{{1,9}}){_GAP}(\d{{1,9}}){_GAP}(\d{{1,5}})\s", rf"(?s)^(P4){_GAP}(\d{{1,9}}){_GAP}(\d{{1,9}})\s"
    part = lambda k: F.when(F.col("is_grey"), F.regexp_extract("head", grey, k)).otherwise(F.regexp_extract("head", bits, min(k, 3)))
    rows = files.select("path", "content", head.alias("head")).withColumn("is_grey", F.col("head").rlike(grey))
    rows = rows.withColumn("known", F.coalesce(F.col("is_grey") | F.col("head").rlike(bits), F.lit(False)))
    rows = rows.withColumn("width", F.when(F.col("known"), part(2).cast("int"))).withColumn("height", F.when(F.col("known"), part(3).cast("int")))
    rows = rows.withColumn("depth", F.when(F.col("is_grey"), F.regexp_extract("head", grey, 4).cast("int")).when(F.col("known"), F.lit(1)))
    line = F.when(F.col("is_grey"), F.col("width").cast("long") * F.when(F.col("depth") > 255, 2).otherwise(1)).otherwise(F.ceil(F.col("width") / 8))
    rows = rows.withColumn("line", line).withColumn("begin", F.length(part(0))).withColumn("body", F.length("content") - F.col("begin"))
    whole = F.col("line") * F.col("height")
    error = F.when(~F.col("known"), "not a P4 or P5 image").when((F.col("width") < 1) | (F.col("height") < 1) | (F.col("depth") < 1) | (F.col("depth") > 65535), "an image without places").when(F.col("body") < whole, "cut").when(F.col("body") > whole, "longer than its header says")
    rows = rows.withColumn("error", error).withColumn("hex", F.when(F.col("error").isNull(), F.hex(F.expr("substring(content, cast(begin as int) + 1)"))))
    digits = lambda at, n: F.conv(F.substring("hex", (2 * at + 1).cast("int"), 2 * n), 16, 10).cast("int")
    places = F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") * F.col("height") - 1)
    one = lambda i: digits(i, 1)
    two = lambda i: digits(2 * i, 2)
    bit = lambda i: F.get(F.array(*(F.shiftright(digits(F.floor(i / F.col("width")) * F.col("line") + F.floor((i % F.col("width")) / 8), 1), k) for k in range(7, -1, -1))), ((i % F.col("width")) % 8).cast("int")).bitwiseAND(1)
    x = F.when(F.col("error").isNotNull(), F.lit(None)).when(~F.col("is_grey"), F.transform(places, bit)).when(F.col("depth") > 255, F.transform(places, two)).otherwise(F.transform(places, one))
    blank = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return rows.select("path", blank("width"), blank("height"), blank("depth"), x.alias("x"), "error")
