"""Token ids in flat binary files with 64-bit offsets, memory-mapped for reading.

Documents are range-partitioned by doc_id and a key of the text, so rows that
share one doc_id can be split, and each partition writes one shard:

    shard-P.bin  the ids of its documents, little-endian unsigned 16-bit
    shard-P.idx  64-bit unsigned offsets within the shard, in ids: one more than it has documents
    shard-P.doc  its doc_ids, signed 64-bit; null ids come first and aren't written

The manifest has a row for each shard; the shards' bases are prefix sums of its
counts, so no pass over the ids is needed to place them.  Ids go to the file as
they are made; a task holds one slice of texts, and 16 bytes for each document
of its shard.  A shard is written under a name of its own and then renamed, so
that a task that runs again, or twice at once, leaves a whole file.
"""

from __future__ import annotations

import functools
import os
import re
import string
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steadfold.llm.common import in_slices, materialize, new_path, text_key

END_ID = 2
KINDS = ("bin", "idx", "doc")
#: Bytes of input that a shard has about, where that takes more shards than there are shuffle partitions.
SHARD, MOST_SHARDS = 1 << 30, 200_000
#: Pieces whose ids a Python worker remembers at most; then it starts anew.
REMEMBERED = 900_000
MARKS = string.punctuation.replace("'", "")
_WHITE = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " "]
#: White space before a space; the further kinds are looked for in texts that aren't plain ASCII.
_ODD = [w + " " for w in _WHITE]
_ODD_WIDE = [chr(c) + " " for c in range(128, 0x3001) if chr(c).isspace()]
_BETWEEN = re.compile(r"(?<=\S)(?= )")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    """The ids of pieces after ``prefix``, a space or nothing, made as they are asked for.

    Between a last letter and closing marks, and on both sides of a single line
    feed, the pattern always cuts, so such pieces are put together from parts.
    """

    def __init__(self, encoder: _Encoder, prefix: str) -> None:
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, piece: str) -> bytes:
        base = piece.rstrip(MARKS)
        if base.isalpha():
            if len(base) < len(piece):
                found = self[base] + self.encoder.mark(piece[len(base) :])
            else:
                found = self.encoder.word(self.prefix, piece)
        elif "\n" in piece and all(x.split() == [x] for x in piece.split("\n")):
            parts = piece.split("\n")
            bare, feed = self.encoder.bare, self.encoder.mark("\n")
            return self[parts[0]] + b"".join([feed + bare[x] for x in parts[1:]])
        else:
            found = self.encoder.ids(self.prefix + piece)
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = found
        return found


class _Encoder:
    """A tokenizer with what it has encoded before."""

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.loaded = Tokenizer.from_file(tokenizer)
        if sys.byteorder != "little":
            raise ValueError("ids are kept as they are in memory, little-endian")
        if max(self.loaded.get_vocab().values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        #: How byte-level vocabularies write each byte.
        self.written = {c: c for c in plain} | {c: 256 + n for n, c in enumerate(c for c in range(256) if c not in plain)}
        self.tokenize = self.loaded.model.tokenize
        self.spaced, self.bare, self.marks = _Pieces(self, " "), _Pieces(self, ""), {}

    def ids(self, text: str) -> bytes:
        return array("H", self.loaded.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self.ids(text)
        return self.marks[text]

    def word(self, prefix: str, text: str) -> bytes:
        """Letters are never cut, so they go to the vocabulary at once."""
        as_bytes = (prefix and "\u0120") + text if text.isascii() else (prefix + text).encode().decode("latin-1").translate(self.written)
        return array("H", [x.id for x in self.tokenize(as_bytes)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.marks) > 100_000:
            self.marks.clear()
        spaced, bare = self.spaced.__getitem__, self.bare
        return [bare[first] + b"".join(map(spaced, rest)) for first, rest in map(_pieces, texts)]


_encoder = functools.cache(_Encoder)


def encode(texts: list[str], tokenizer: str) -> list[bytes]:
    """The ids of each whole text, as little-endian unsigned 16-bit integers.

    The vocabulary's own pattern never lets a token run on from a character
    that isn't white space into a space.  So texts are cut there, and a piece
    that was seen before needs no second encoding; the ids are those of the
    whole text by the tokenizer's plain call without added special tokens, so a
    special token that a text quotes has its own id.
    """
    return _encoder(tokenizer).encode(texts)


def _pieces(text: str) -> tuple[str, list[str]]:
    """The text up to the first cut, and the pieces after it without the space in front of each."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _ODD) or not text.isascii() and any(x in text for x in _ODD_WIDE):
        first, *rest = _BETWEEN.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


def _local(uri: str) -> str | None:
    """The path of a URI in a mounted file system, else None."""
    return re.sub("^file:/*", "/", uri) if uri.startswith(("file:", "/")) else None


class _Files:
    """The three files of a shard, under names of this attempt until all of them are whole."""

    def __init__(self, uri: str) -> None:
        path, self.mark = _local(uri), uuid.uuid4().hex
        if path is None:
            fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
            self.open, self.rename = fs.open_output_stream, fs.move
        else:
            self.path, self.open, self.rename = path, functools.partial(open, mode="wb"), os.replace
        self.ids, self.offsets, self.docs = (self.open(f"{self.path}.{kind}.{self.mark}") for kind in KINDS)

    def close(self) -> None:
        for file in (self.ids, self.offsets, self.docs):
            file.close()
        for kind in KINDS:
            self.rename(f"{self.path}.{kind}.{self.mark}", f"{self.path}.{kind}")


def _writer(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files, n_docs, n_nulls, at = TaskContext.get().partitionId(), None, 0, 0, 0
        end = np.array([END_ID], "<u2").tobytes()
        for batch in in_slices(batches):
            if not batch.num_rows:
                continue
            if files is None:
                files = _Files(f"{folder}/shard-{shard:06d}")
                files.offsets.write(np.zeros(1, "<u8").tobytes())
            found = encode([t or "" for t in batch.column(1).to_pylist()], tokenizer)
            files.ids.write(end.join([*found, b""]))
            ends = at + np.cumsum([len(x) // 2 + 1 for x in found], dtype=np.uint64)
            files.offsets.write(ends.astype("<u8").tobytes())
            at = ends[-1]
            here = batch.column(0).drop_null()
            files.docs.write(here.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += batch.num_rows
            n_nulls += batch.num_rows - len(here)
        if files is not None:
            files.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_null": [n_nulls], "n_tokens": [int(at)]})

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, shards: int | None = None) -> tuple[str, DataFrame]:
    """Write the token files of ``docs`` (doc_id, text) into a shared folder: the folder, and the manifest.

    The manifest has shard, n_docs, n_null, n_tokens, and the prefix sums
    first_doc and base.  A null text counts as empty; every document ends in
    END_ID.  Documents are in ascending doc_id order, null ids first, rows of
    one doc_id in the order of a key of their texts; an empty table gives no
    shards.  ``shards`` is how many there are at most; without it one for each
    SHARD bytes that Spark expects ``docs`` to have, or each shuffle partition.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), text_key(F.col("text")))
    expected = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SHARD
    shards = shards or (min(expected, MOST_SHARDS) if expected > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)
    ranges = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    ordered = ranges.sortWithinPartitions(*order)
    shards = materialize(ordered.mapInArrow(_writer(folder, tokenizer or default_tokenizer()), "shard int, n_docs long, n_null long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)), "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))}
    return folder, materialize(shards.withColumns(sums).repartition("shard"), "manifest")


def _mapped(uri: str, kind: str, dtype: str):
    """A file's integers, memory-mapped where the file system is mounted; else its bytes as a buffer."""
    if (path := _local(uri)) is not None:
        name = f"{path}.{kind}"
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{path}.{kind}") as source:
        return np.frombuffer(source.read_buffer(), dtype)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{folder}/shard-{row['shard']:06d}"
                ids, offsets, docs = _mapped(at, "bin", "<u2"), _mapped(at, "idx", "<u8"), _mapped(at, "doc", "<i8")
                names = [None] * row["n_null"] + docs.tolist()
                for i in range(0, len(names), 8192):
                    bounds = offsets[i : i + 8193].astype(np.int64)
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 8192], pa.int64()), pa.array(row["base"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, and ids_crc32 over its ids as unsigned 32-bit."""
    return manifest.select("shard", "n_null", "base").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(folder: str, shard: int, index: int) -> np.ndarray:
    """The ids of one document of a shard, end id included, without reading the others."""
    offsets = _mapped(f"{folder}/shard-{shard:06d}", "idx", "<u8")
    return np.array(_mapped(f"{folder}/shard-{shard:06d}", "bin", "<u2")[int(offsets[index]) : int(offsets[index + 1])])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(*write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
