"""Benchmark decontamination by a prefix-filtered set join.

A window is ITEM consecutive words of a benchmark item (an item of fewer words
is one window).  Windows and documents are taken as sets of positioned
shingles of SHINGLE words; a shorter window is one shingle.  A document holds a
window exactly if it holds all the window's shingles at consecutive places, so
any one of them is a necessary prefix; the rarest over all documents is taken.

1. A bit map has the hashes of all benchmark shingles.  It is as large as their
   number asks for, within a bound, is built by aggregation, and is the only
   thing that is broadcast.
2. One pass over the texts keeps the positioned shingles that the bit map lets
   through, with their words, and those alone go on as rows.
3. Their frequencies order each window's shingles by rarity; documents join the
   windows on the rarest one, by its words.
4. A candidate must fit between the document's ends (length and positional
   bounds), and every shingle of it must be found at its own place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.llm.common import LOWER, NOT_WORD, UPPER, bit_map, bits_for, in_slices, is_set, map_size, materialize, text_key
from steadfold.sources.names import unused

ITEM = 10
SHINGLE = 5

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased; null has none."""
    return (text or b"").translate(_TABLE).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _places(found: np.ndarray, size: int = 32) -> np.ndarray:
    return (found >> np.uint64(64 - size)).astype(np.int64)


def _item_windows(item: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                size = min(item, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    part = words[at : at + size]
                    k = min(shingle, size)
                    cells = _places(_shingle_hashes(_hashes(part), k)).tolist()
                    rows += [(ident, b" ".join(part).decode(), size, j, b" ".join(part[j : j + k]).decode(), k, c) for j, c in enumerate(cells)]
            names = ["item", "win", "size", "j", "shingle", "k", "cell"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _hits(bits: np.ndarray, sizes: list[int]):
    cells = map_size(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts, ends, places, widths, shingles = [], [0], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                hashes = _hashes(words)
                for k in sizes:
                    found = np.flatnonzero(is_set(bits, _places(_shingle_hashes(hashes, k), cells)))
                    places.append(found.astype(np.int32))
                    widths.append(np.full(len(found), k, np.int32))
                    shingles.append(pa.array([b" ".join(words[p : p + k]) for p in found.tolist()], pa.binary()).cast(pa.string()))
                counts.append(len(words))
                ends.append(ends[-1] + sum(map(len, places[len(places) - len(sizes) :])))
            flat = [pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (places, widths)]
            flat.append(pa.concat_arrays(shingles) if shingles else pa.array([], pa.string()))
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["pos", "k", "shingle"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), hits], ["doc_id", "n_words", "hits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, item: int = ITEM, shingle: int = SHINGLE) -> DataFrame:
    """Every row's doc_id, n_words, n_hit, n_items, and items: the sorted ids, as strings, of items with an occurring window.

    Needs doc_id and text, item_id and text.  Null and empty texts have no
    words and no windows; an item whose id is null can hit words but isn't
    counted or listed; repeated rows each get their row, and items with the
    same words are all listed.  Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_item_windows(item, shingle), "item string, win string, size int, j int, shingle string, k int, cell long")
    items = materialize(items, "item-windows")
    owners = items.where("j = 0").select("win", "item").distinct()
    windows = items.select("win", "size", "j", "shingle", "k", "cell").distinct()
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())
    size = bits_for(windows.count())
    bits = spark.sparkContext.broadcast(bit_map(windows.select(F.shiftright("cell", 32 - size).alias("cell")), size))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hits(bits.value, sizes)(batches)

    scanned = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, hits array<struct<pos:int,k:int,shingle:string>>")
    rows = materialize(scanned.withColumn("rid", F.monotonically_increasing_id()), "hits")
    hits = rows.select("rid", "n_words", F.explode("hits").alias("h")).select("rid", "n_words", "h.*")

    seen = hits.groupBy("shingle", "k").agg(F.count("*").alias("seen"))
    ordered = windows.join(seen, ["shingle", "k"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.coalesce("seen", F.lit(0)), "j")))
    whole = windows.groupBy("win").agg(F.expr("transform(array_sort(collect_list(struct(j, shingle))), x -> x.shingle)").alias("shingles"))
    prefix = ordered.where("rank = 1 AND seen IS NOT NULL").select("win", "size", "j", "shingle", "k").join(whole, "win")
    prefix = materialize(prefix.withColumn("wid", F.monotonically_increasing_id()), "prefixes")

    keyed = hits.join(prefix.select("wid", "size", "j", "shingle", "k", "shingles"), ["shingle", "k"]).withColumn("start", F.expr("pos - j"))
    within = keyed.where("start >= 0 AND start + size <= n_words").select("rid", "wid", "size", "start", "k", F.posexplode("shingles").alias("j", "shingle"))
    wanted = within.select("rid", "wid", "size", "start", "k", "shingle", F.expr("start + j").alias("pos"))
    at = materialize(wanted.join(hits.select("rid", "pos", "k", "shingle"), ["rid", "pos", "k", "shingle"]).groupBy("rid", "wid", "size", "start").agg(F.count("*").alias("n")).where(F.col("n") == F.expr(f"size - least(size, {shingle}) + 1")), "occurrences")

    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = at.select("rid", "start", F.expr("start + size").alias("end")).distinct().withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("rid").agg(F.sum(F.expr("greatest(0, end - greatest(start, past))")).alias("n_hit"))
    listed = at.select("rid", "wid").distinct().join(prefix.select("wid", "win"), "wid").join(owners, "win").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.select("rid", "doc_id", "n_words").join(hit, "rid", "left").join(listed, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, without a hit word.  Rows with the same text stay or go together.

    Null and empty texts have no words and stay; so does everything where the
    benchmark is empty.  Repeated rows and null ids are rows like others; an
    empty table gives an empty result.
    """
    key = unused(docs.columns, "key")[0]
    found = contamination(docs.select(text_key(F.col("text")).alias("doc_id"), "text"), benchmark)
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, text_key(F.col("text")) == F.col(key), "left_anti")


def digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NOT_WORD}]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NOT_WORD}]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), {ITEM}) AS size, unnest(range(1, len(w) - least(len(w), {ITEM}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""
