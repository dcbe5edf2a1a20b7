"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's fingerprint has 64 bits.  The tables of a covering family are
structured bit masks: each bit position gets a non-zero vector of RADIUS + 1
bits, and each non-zero vector v gives the mask of the positions whose vector
has an odd product with v.  Fewer than RADIUS + 1 differing positions span less
than the whole space, so some v is orthogonal to all of them: that table's mask
has none of them, and the pair collides there.  No pair within the radius is
missed, unlike with random masks.

Only distinct fingerprints are compared.  Within a bucket a breadth-first
search emits the links of a spanning forest, never all pairs.  A bucket of over
BUCKET fingerprints isn't gathered: its members are hashed again by masks over
the bits that the bucket leaves free, which is exact for the same reason.  Such
a member becomes one row for each table at the next level, of which about half
the bits that were free still are, so members of large buckets are 15 rows at
each of at most six levels, and a bucket without free bits has one fingerprint.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import connected_components, in_slices, materialize, text_key
from steadfold.sources.names import unused

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = [words[k:] for k in range(shingle)]
    shingles = map(b" ".join, zip(*parts, strict=False)) if len(words) > shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        found = [fingerprint(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (64-bit hash of the text) and fp of every row; a null text counts as empty."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def covering_masks(radius: int, level: int) -> list[int]:
    """The 2^(radius+1)-1 masks of one level, as signed 64-bit integers."""
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(64)]
    random.Random(1000 * radius + level).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what differs in at most ``radius`` bits: at most len(fps) - 1."""
    links, left = [], fps
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count((front[:256, None] ^ left[None, :]).view(np.uint64)) <= radius
            hit = near.any(axis=0)
            links += zip(left[hit].tolist(), front[near.argmax(axis=0)[hit]].tolist(), strict=True)
            front, left = np.concatenate([front[256:], left[hit]]), left[~hit]
    return links


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come sorted; the last of a batch may go on in the next, and has BUCKET members at most."""
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            used, part, fp = (np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True))
            starts = np.flatnonzero(np.r_[True, (used[1:] != used[:-1]) | (part[1:] != part[:-1])]) if len(fp) else np.empty(0, np.int64)
            links: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                links += forest(fp[a:b], radius)
            kept = [x[starts[-1] :] if len(starts) else x for x in (used, part, fp)]
            if links:
                yield _as_links(links)
        if links := forest(kept[2], radius):
            yield _as_links(links)

    return run


def _as_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all pairs within the radius would."""
    found, rows, level = None, fps.select(F.lit(0).cast("long").alias("used"), "fp"), 0
    while True:
        masks = F.explode(F.array(*(F.lit(m).cast("long") for m in covering_masks(radius, level))))
        rows = rows.select("fp", "used", masks.alias("mask")).select(F.expr("used | mask").alias("used"), F.expr("fp & (used | mask)").alias("part"), "fp").distinct() if level else rows.select("fp", masks.alias("used")).select("used", F.expr("fp & used").alias("part"), "fp")
        counts = materialize(rows.groupBy("used", "part").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        small = rows.join(counts.where(F.col("n") <= bucket).select("used", "part"), ["used", "part"])
        links = small.repartition("used", "part").sortWithinPartitions("used", "part", "fp").select("used", "part", "fp").mapInArrow(_bucket_links(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        large = counts.where(F.col("n") > bucket).select("used", "part")
        if large.isEmpty():
            return found.distinct()
        rows, level = materialize(rows.join(large, ["used", "part"]).select("used", "fp").distinct(), "large"), level + 1


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row's doc_id, text_key, fp, root, and component_id: the smallest doc_id that it is linked to.

    ``root`` is the smallest fingerprint of the component, which tells
    components apart where doc_ids repeat.
    Fingerprints link at ``radius`` or fewer differing bits, and links chain.
    Texts without words (null ones too) all have fingerprint zero.  Repeated
    rows each get their row.  A row whose doc_id is null takes part and gets
    its row; component_id is null where a whole component has no doc_id.  An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = materialize(connected_components(near_links(fps.select("fp"), radius)), "roots")
    members = roots.join(fps, roots["node"] == fps["fp"]).select("fp", "root", "low")
    least = members.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = members.join(least, "root").select("fp", "root", "component_id", F.lit(True).alias("is_linked"))
    # Written, so that the last join is of two sides only and Spark can split a fingerprint with very many copies.
    each = fps.join(linked, "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("root")).otherwise(F.col("fp")).alias("root"), F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    each = materialize(each, "components")
    return rows.join(each, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of its smallest doc_id.

    Null doc_ids come last, and of rows with the same doc_id the one with the
    smallest key of its text stays; of rows that share both, any one does.  A
    null text counts as empty, and all texts without words are one component.
    An empty table gives an empty result.  All columns of ``docs`` are returned
    as they are, whatever their names.
    """
    alike = near_duplicates(docs, radius).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    least = alike.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_key", "n")).alias("one")).select("one.*")
    ident, key, more, own = unused(docs.columns, "ident", "key", "more", "own")
    chosen = materialize(least.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key), F.expr("n > 1").alias(more)), "kept")
    keyed = docs.withColumn(own, text_key(F.col("text")))
    found = keyed.join(chosen, (F.col(key) == F.col(own)) & F.col(ident).eqNullSafe(F.col("doc_id"))).drop(ident, key, own)
    once = found.where(~F.col(more)).drop(more)
    if not chosen.where(more).isEmpty():
        once = once.unionByName(found.where(more).drop(more).dropDuplicates(["doc_id", "text"]))
    return once


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
