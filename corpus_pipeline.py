"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.  All but the
last return the columns of documents, rows as they are:

1. language      drops documents without a letter, or whose language isn't clear
2. near_copies   keeps one document of each group of near copies, whose
                 fingerprints differ in RADIUS bits at most, and chain
3. benchmark     drops documents that hold a benchmark window
4. mixture       repeats or drops documents so that sources meet their weights
5. tokens        writes token files and returns what they say of each document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadfold.llm import decontaminate, language_id, mixing, simhash, token_files
from steadfold.llm.common import made, settle


#: Documents that are alike to 0.8 in shingles of five words differ in 3 to 11 bits mostly; a covering family that misses
#: no pair has 2^(RADIUS + 1) - 1 tables, so the stage goes beyond the 3 bits of the query, but not as far as 11.
RADIUS = 5


# Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, and returns all columns
# of its rows as they are, whatever their names; what each does with them its operator says.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a null text, without a letter, or whose language is not clear, go; an empty table gives an empty one."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group the smallest doc_id stays, null ones last, and one of equal rows; texts without words are one group."""
    return simhash.keep_one(docs, RADIUS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window go, and rows of the same text together; null and empty texts, and null ids, stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources are one source; null texts have no words and are copied or not on their own; equal rows share copies out."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text counts as empty; null ids come first; an empty table gives no shards and no rows."""
    return token_files.read_digests(*token_files.write_tokens(docs))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: A trained network decides in the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before it kept.

    Once a stage's result is written, what it was made from is removed; the
    last stage's token files and what they were made from stay.
    """
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(made())
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
