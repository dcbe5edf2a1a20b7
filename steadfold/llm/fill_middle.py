"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together again in another order.

A text is cut between code points, but its bytes are what is moved.  The bytes
of a slice of texts have one packed bit vector, a bit set where a code point
begins, and a directory of how many bits are set before each block of 512.
``rank`` counts the bits set before a byte and ``select`` finds the byte of a
given bit, both by the directory, then within one block.  A text's code points
are the difference of two ranks, and the bytes of its two cuts are two selects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfold.llm.common import in_slices
from steadfold.sources.names import unused

SEED = 1
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: texts that are left as they are, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
WORDS = 8


class Boundaries:
    """Where code points begin in UTF-8 bytes, as packed words of 64 bits with a directory of WORDS words a block."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        blocks = self.size // (64 * WORDS) + 1
        self.words = np.zeros(blocks * WORDS, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.within = np.zeros((blocks, WORDS + 1), np.int64)
        np.cumsum(np.bitwise_count(self.words).reshape(blocks, WORDS), axis=1, out=self.within[:, 1:])
        self.before = np.concatenate([[0], np.cumsum(self.within[:, -1])])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before byte ``at``, which may be the end."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word // WORDS] + self.within[word // WORDS, word % WORDS] + np.bitwise_count(below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte at which code point ``nth``, from 0, begins; the end if there are no more."""
        known = nth < self.before[-1]
        n = np.where(known, nth, 0)
        block = np.searchsorted(self.before, n, side="right") - 1
        block = np.minimum(block, len(self.within) - 1)
        left = n - self.before[block]
        word = (self.within[block, 1:] <= left[:, None]).sum(axis=1)
        word = np.minimum(word, WORDS - 1)
        left = left - self.within[block, word]
        bits = np.unpackbits(self.words[block * WORDS + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        return np.where(known, (block * WORDS + word) * 64 + bit, self.size)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, one after the other, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(texts: pa.Array, form: list[str], low: np.ndarray, high: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Outputs, code points, and code points of prefix and middle, of texts that are cut by two draws each."""
    data, offsets = _flat(texts)
    bounds = Boundaries(data)
    first = bounds.rank(offsets)
    n = np.diff(first)
    a, b = low % (n + 1), high % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    start, end = offsets[:-1], offsets[1:]
    one = np.where(a < n, bounds.select(first[:-1] + a), end)
    two = np.where(b < n, bounds.select(first[:-1] + b), end)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    body, out = data.tobytes(), []
    for i, (s, x, y, e) in enumerate(zip(start.tolist(), one.tolist(), two.tolist(), end.tolist(), strict=True)):
        if form[i] == "psm":
            out.append(b"".join((marks[0], body[s:x], marks[1], body[y:e], marks[2], body[x:y])))
        elif form[i] == "spm":
            out.append(b"".join((marks[1], body[y:e], marks[0], body[s:x], marks[2], body[x:y])))
        else:
            out.append(body[s:e])
    return out, n, a, b - a


def _cuts(names: list[str]):
    """(others, text, form, low, high) -> (others, form, output, n, prefix_chars, middle_chars), under ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            keep = batch.num_columns - 4
            form = batch.column(keep + 1).to_pylist()
            draws = [batch.column(keep + k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            out, n, a, b = _cut(batch.column(keep), form, *draws)
            plain = np.array([x == "plain" for x in form], bool)
            made = [batch.column(keep + 1), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(a, pa.int64(), mask=plain), pa.array(b, pa.int64(), mask=plain)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], names)

    return run


_MADE = {"form": T.StringType(), "output": T.StringType(), "n": T.LongType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}


def _transformed(docs: DataFrame, others: list[str], seed: int, plain: int, suffix_first: int) -> tuple[DataFrame, dict[str, str]]:
    """``others`` and what is made, and the names that the latter have there."""
    body, hashed, low, high, *own = unused(docs.columns, "body", "hash", "low", "high", *_MADE)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(body), F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256).alias(hashed))
    draw = lambda k: F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.col(body).contains(PREFIX) | F.col(body).contains(SUFFIX) | F.col(body).contains(MIDDLE)
    form = F.when((F.col(body) == "") | marked | (draw(2) % 100 >= 100 - plain), "plain").when(draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    asked = rows.select(*others, body, form.alias(own[0]), draw(0).alias(low), draw(1).alias(high))
    schema = T.StructType([*(docs.schema[c] for c in others), *(T.StructField(o, kind) for o, kind in zip(own, _MADE.values(), strict=True))])
    return asked.mapInArrow(_cuts([*others, *own]), schema), dict(zip(_MADE, own, strict=True))


def transform(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
    middle) or ``plain``, which has no lengths and the text itself as output.
    All draws are parts of the SHA-256 of seed and doc_id, so reruns agree and
    rows of the same doc_id are drawn alike.  Empty texts, and those that
    contain a mark, are plain; a null text counts as empty; a null doc_id is
    drawn for as an empty one.  Repeated rows each get their row; an empty table
    gives an empty result; other columns don't matter.  A narrow map, without a
    shuffle.
    """
    found, name = _transformed(docs, ["doc_id"], seed, plain, suffix_first)
    return found.select("doc_id", *(F.col(name[c]).alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")))


def rewrite(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs``, all columns as they are, whatever their names, but for texts in their new form; null texts become empty."""
    found, name = _transformed(docs, [c for c in docs.columns if c != "text"], seed, plain, suffix_first)
    return found.select(*(F.col(name["output"]).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from.

    No text in one of the two cut forms contains a mark, and a mark can't begin
    within another one, so the marks are found where they were set.
    """
    after = lambda x, mark: F.substring(x, F.instr(x, mark) + len(mark), F.length(x))
    before = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, a) AS x, substr(text, a + 1, b - a) AS y, substr(text, b + 1, n - b) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y ELSE '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
