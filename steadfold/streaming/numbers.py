"""Numbered batches as a streaming source: its offset is the number of the next batch.

A batch is a list of places in a table; joined with the table's places it is a
stream of rows.  Batches go on over the end of the table, or start anew there.
A trigger has so many batches, and a query that is started again goes on behind
the last ones that its checkpoint knows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from steadfold.sources import runs
from steadfold.sources.dataset import Batches

#: Places that one task makes, and rows of a trigger up to which they are sent to all tasks.
PLACES, SMALL = 1 << 16, 1 << 18


@dataclass
class Stretch(InputPartition):
    """Places ``first`` to ``end`` of a batch, counted within it."""

    batch: int
    first: int
    end: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.n, self.size, self.per, self.last = (int(options[k]) for k in ("rows", "size", "per", "last"))
        self.wraps, self.at = options["wraps"] == "true", int(options["begun"])
        if self.n < 1 or self.size < 1 or self.per < 1:
            raise ValueError("a source without rows, or batches or triggers without any, can't be sampled from")

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.per, self.last)
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = []
        for b in range(start["batch"], end["batch"]):
            many = self.size if self.wraps else min(self.size, self.n - b % math.ceil(self.n / self.size) * self.size)
            found += [Stretch(b, k, min(k + PLACES, many)) for k in range(0, many, PLACES)]
        return found

    def read(self, partition: Stretch) -> Iterator[tuple[int, int]]:
        first = partition.batch * self.size if self.wraps else partition.batch % math.ceil(self.n / self.size) * self.size
        for k in range(partition.first, partition.end):
            yield partition.batch, (first + k) % self.n


class BatchNumbers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "steadfold_batches"

    def schema(self) -> str:
        return "batch long, place long"

    def streamReader(self, schema: object) -> Reader:
        return Reader(self.options)


def begun(spark: SparkSession, folder: str) -> int:
    """The number behind the last batch that a checkpoint has planned; 0 without one."""
    if not runs.exists(spark, f"{folder}/checkpoint/offsets"):
        return 0
    plans = spark.read.option("pathGlobFilter", "[0-9]*").text(f"{folder}/checkpoint/offsets", wholetext=True)
    newest = plans.select(F.regexp_extract("_metadata.file_name", "[0-9]+", 0).cast("long").alias("n"), "value").orderBy(F.desc("n")).first()
    return int(json.loads(newest.value.strip().splitlines()[-1])["batch"]) if newest else 0


def numbers(spark: SparkSession, folder: str, rows: int, size: int, last: int, per: int = 1, wraps: bool = True) -> DataFrame:
    """Batches up to ``last``, without it, as a stream (batch, place) of a query whose checkpoint is in ``folder``."""
    spark.dataSource.register(BatchNumbers)
    options = {"rows": rows, "size": size, "per": per, "last": last, "wraps": str(wraps).lower(), "begun": begun(spark, folder)}
    if rows < 1:
        raise ValueError("a source without rows can't be sampled from")
    return spark.readStream.format(BatchNumbers.name()).options(**options).load()


def sampled(batches: Batches, folder: str, last: int, per: int = 1) -> DataFrame:
    """The batches of a table as a stream (batch, and the table's columns)."""
    asked = numbers(batches.placed.sparkSession, folder, batches.n, batches.size, last, per, batches.wraps)
    asked = F.broadcast(asked) if batches.size * per <= SMALL else asked
    return asked.join(batches.placed, asked["place"] == batches.placed["rn"]).select("batch", *batches.columns)


def by_step(rows: DataFrame, folder: str, steps: int, per: int = 1) -> DataFrame:
    """Rows with ``step``, from 0, as a stream whose batch k has the rows of step k."""
    asked = numbers(rows.sparkSession, folder, max(steps, 1), 1, steps, per)
    return F.broadcast(asked).join(rows, asked["place"] == rows["step"]).drop("place", "step")


def until_done(stream: DataFrame, folder: str, mode: str, sink: Callable[[object], object]) -> None:
    """Run a query until no batch is left; what it has done is kept in ``folder``, from which it goes on."""
    query = sink(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
