"""What the corpus operators share: intermediate tables, bit maps and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.sources import scratch

#: ASCII white space, the separators of the plain words.
SPACE = r"\x20\x09-\x0D"
#: What the licence and benchmark words don't contain; A-Z are lower-cased first.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


made = scratch.made
new_path = scratch.folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again.

    This cuts the lineage, so that a lost executor costs only what it was
    working on, and values such as row ids stay the same from then on.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """``df``, written and read again; what this thread has written since ``made()`` had that length goes.

    For results that are whole before anything else is asked of what they were
    made from, such as a stage's; other tables stay until they are removed.
    """
    out = materialize(df, label)
    for path in made()[since:-1]:
        scratch.drop(df.sparkSession, path)
    del made()[since:-1]
    return out


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most: what a worker makes of a batch is several times as large as the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; null texts and empty ones differ."""
    return F.xxhash64(text, F.isnull(text))


def bits_for(entries: int, least: int = 24, most: int = 28) -> int:
    """The size of a bit map, as a power of two, that has 16 cells or more for each entry; within bounds of 2 MB and 32 MB.

    Beyond the upper bound more cells are set by chance: more rows go on than
    need to, and none is lost.
    """
    return max(least, min(most, (16 * max(entries, 1) - 1).bit_length()))


def bit_map(cells: DataFrame, size: int) -> np.ndarray:
    """A map of 2^size bits, as bytes, with those set that the column ``cell`` names.

    It is built by aggregation; one row for each 32 bits at most comes here, so
    its size and the driver's part are bounded by ``size``, whatever the data.
    """
    words = cells.groupBy((F.col("cell") / 32).cast("long").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 32 as int)))").alias("bits"))
    found = words.where("at IS NOT NULL").select(F.col("at").cast("int"), F.col("bits").cast("long")).toArrow()
    bits = np.zeros(1 << (size - 5), "<u4")
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def map_size(bits: np.ndarray) -> int:
    return (8 * len(bits) - 1).bit_length()


def is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``: ``(node, root)``.

    Alternates the large-star and the small-star step until the links stay as
    they are; then each node of a component is linked to its smallest one.
    Every step is one aggregate, whose minima are combined before the shuffle,
    and one join, whose other side has one row a node, so that a node with very
    many links can be split.  Links to null and of a node to itself are left
    out; no links give an empty result.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen, path = None, None
    while True:
        old, path = path, new_path(spark, "links")
        now.write.parquet(path)
        if old:
            scratch.drop(spark, old)
        now = spark.read.parquet(path)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) % 1000003)")).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(least.withColumnRenamed("m", "b")).distinct()
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
