"""Quality rules kept as a ledger of failure bits and measurements.

Each text is measured once and every rule is evaluated once; the ledger holds
the measurements and a 64-bit mask of the rules that failed.  A policy is a
versioned mask, so applying another policy, or asking what a rule does within
one, is bit arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.llm.common import in_slices, materialize

WINDOW = 8
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "top_word", "n_upper", "n_letters", "n_digits")

#: Rules in bit order, as conditions on the measurements that hold where the rule fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "10 * word_chars < 22 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "line_repeats": "10 * n_dup_lines > 6 * n_lines",
    "one_word": "n_words >= 20 AND 100 * top_word > 30 * n_words",
    "capitals": "n_letters >= 20 AND 10 * n_upper > 4 * n_letters",
    "digits": "10 * n_digits > 4 * word_chars",
}
BASE = ("few_words", "repeats")
#: Versioned policies: a document goes if one of these rules fails.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "line_repeats", "one_word"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of WINDOW words that occurs twice or more.

    Words are numbered, and windows are told apart by 64-bit hashes of their
    numbers; where hashes are equal the numbers themselves decide.  It takes
    some 50 bytes a word, however long the text is.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    inner = np.r_[False, same] | np.r_[same, False]
    at = order[inner]  # windows whose hash another one has, side by side with it
    group = np.cumsum(np.r_[True, ranked[inner][1:] != ranked[inner][:-1]])
    agree = np.ones(len(at) - 1, bool)
    for k in range(WINDOW):
        agree &= ids[at[1:] + k] == ids[at[:-1] + k]
    twice = np.zeros(n, bool)
    if (agree | (group[1:] != group[:-1])).all():
        twice[at] = True
    else:  # some equal hashes are of different windows
        rows = np.stack([ids[at + k] for k in range(WINDOW)], axis=1)
        _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice[at[count[which.ravel()] > 1]] = True
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements, in the order of MEASURES, of a text in UTF-8; null counts as empty."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    count = lambda chars: len(joined) - len(joined.translate(None, chars))
    top = max(Counter(words).values(), default=0)
    return (len(words), len(joined.decode()), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), top, count(UPPER), count(LETTERS), count(DIGITS))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        columns = list(zip(*map(measure, texts), strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measurements, and ``failures``, the mask of failed rules.

    Needs doc_id and text.  A null text counts as empty, and an empty one fails
    ``few_words`` alone; repeated rows each get their row; a null doc_id is
    kept; an empty table gives an empty ledger.  No shuffle: a narrow map.
    """
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measured, out)
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())), F.lit(0))
    return rows.withColumn("failures", bits.cast("long"))


def fails(policy: tuple[str, ...], failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept``: false where a rule of that version failed."""
    return rows.withColumn("kept", ~fails(POLICIES[version]))


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, failed, only (documents that go by this rule alone), kept_without.

    The ledger is reduced to one count for each distinct mask before the
    shuffle, at most 2 to the number of rules; the rest is done on those.  An
    empty ledger has no masks and gives no rows.
    """
    policy = POLICIES[version]
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in policy)))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder and read again: policies and ablations then never measure a text."""
    return materialize(ledger(docs), "ledger")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), (F.col("kept") & ~fails(BASE)).alias("kept"), "failures")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does within it."""
    return ablation(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_MEASURED = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
words AS (SELECT rid, unnest(w) AS word FROM d),
tops AS (SELECT rid, max(n) AS top_word FROM (SELECT rid, word, count(*) AS n FROM words GROUP BY ALL) GROUP BY rid),
windows AS (
  SELECT rid, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(top_word, 0)::BIGINT AS top_word,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits
  FROM d LEFT JOIN line_counts USING (rid) LEFT JOIN tops USING (rid) LEFT JOIN covered USING (rid))
"""
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
_MASK = mask(POLICIES[CURRENT])
SQL = rf"""{_MEASURED}, l AS (SELECT *, ({_BITS})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & {mask(BASE)} <> 0 AS base_failed, failures & {_MASK | mask(BASE)} = 0 AS kept, failures
FROM l
"""
_RULES = ", ".join(f"('{r}', {mask((r,))})" for r in POLICIES[CURRENT])
ABLATION_SQL = rf"""{_MEASURED}, l AS (SELECT ({_BITS}) & {_MASK} AS bits FROM m), rules(rule, bit) AS (VALUES {_RULES})
SELECT rule, count(*) FILTER (bits & bit <> 0) AS failed, count(*) FILTER (bits = bit) AS only, count(*) FILTER (bits = 0 OR bits = bit) AS kept_without
FROM rules, l GROUP BY rule
"""
