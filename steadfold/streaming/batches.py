"""Rules over streams: micro-batches as steps, windows of event time as steps, and training with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from steadfold.operators import kernels, rules, training
from steadfold.sources.dataset import Batches
from steadfold.streaming import numbers


def each_batch(stream: DataFrame, folder: str, act: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run ``act`` on all micro-batches there are; the checkpoint lets a stopped query go on where it was."""
    stream.writeStream.foreachBatch(act).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def aggregated(rows: DataFrame, folder: str, files: int = 8) -> DataFrame:
    """Median of each step of (step, worker, g), from files that are read one a micro-batch: (step, pos, val).

    A step's rows come in one batch, since files are split by step.
    """
    spark = rows.sparkSession
    rows.repartition(files, "step").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    each_batch(stream, folder, lambda part, number: rules.median(part).write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
    return spark.read.parquet(f"{folder}/out").select("step", "pos", "val")


def bucketed(events: DataFrame, width: str = "1 day", late: str = "1 hour", workers: int = 16) -> DataFrame:
    """Events (ts, user_id, value) as (start, worker, n, value): users, by their id modulo ``workers``, are the workers of a window, and their mean is what they submit.

    Works on streams, with a watermark, and on tables.
    """
    bucket = F.pmod("user_id", F.lit(workers)).cast("int").alias("worker")
    marked = events.withWatermark("ts", late).select(F.window("ts", width).alias("w"), bucket, "value")
    return marked.groupBy("w", "worker").agg(F.count("*").alias("n"), F.avg("value").alias("value")).select(F.col("w.start").alias("start"), "worker", "n", "value")


def ruled(buckets: DataFrame) -> DataFrame:
    """Buckets of windows as (start, n, mean, median): the average and the median rule over each window's workers."""
    rows = buckets.where("value IS NOT NULL").select(F.col("start").alias("step"), "worker", F.array("value").alias("g"))
    found = rules.average(rows).select("step", F.col("val").alias("mean")).join(rules.median(rows).select("step", F.col("val").alias("median")), "step")
    return buckets.groupBy("start").agg(F.sum("n").alias("n")).join(found.withColumnRenamed("step", "start"), "start", "left").select("start", "n", "mean", "median")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour", workers: int = 16) -> DataFrame:
    """A table's events as (start, n, mean, median), by the rules over each window's workers."""
    return ruled(bucketed(events, width, late, workers))


def windowed_stream(events: DataFrame, folder: str, batches: int = 8, last: int | None = None, width: str = "1 day", late: str = "1 hour", workers: int = 16) -> DataFrame:
    """The same from a stream of the events in the order of time, in so many batches, as far as batch ``last``.

    Each batch writes the buckets that it has changed, and those behind the
    watermark leave the state.  The newest version of each bucket is what all
    batches together come to, the open windows included.  A query that was
    stopped goes on from its batch.
    """
    spark = events.sparkSession
    placed = Batches(events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value"), 0, "ts", "user_id", "value", name="events")
    placed.size = -(-placed.n // batches)
    stream = numbers.numbers(spark, folder, placed.n, placed.size, batches if last is None else last, wraps=False)
    rows = placed.placed
    buckets = bucketed(stream.join(rows, stream["place"] == rows["rn"]).select("ts", "user_id", "value"), width, late, workers)

    def act(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/buckets/batch={number}")

    numbers.until_done(buckets, folder, "update", lambda w: w.foreachBatch(act))
    changed = spark.read.schema(T.StructType([*buckets.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/buckets")
    newest = changed.groupBy("start", "worker").agg(F.max_by(F.struct("n", "value"), "batch").alias("b"))
    return ruled(newest.select("start", "worker", "b.*"))


@dataclass(frozen=True)
class Settings:
    """Of one run of streamed training: a rule with its number of arbitrary workers, and the optimizer's rate and momentum."""

    rule: str = "median"
    f: int = 0
    rate: float = 0.5
    momentum: float = 0.9
    model: str = "logit"


class Trainer(StatefulProcessor):
    """Training steps whose parameters and velocity are a run's state.

    A run's rows come in parts of some thousands, of which only sums by worker
    are kept, so a step may have any number of rows.
    """

    def __init__(self, width: int, settings: dict[str, Settings]) -> None:
        self.width, self.settings = width, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("weights", "params array<double>, velocity array<double>, step long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        o, kept = self.settings[key[0]], self.state.get() if self.state.exists() else None
        params, velocity = (np.array(kept[k]) for k in (0, 1)) if kept else (np.zeros(self.width + 1), np.zeros(self.width + 1))
        step, sums, counts = kept[2] if kept else 0, {}, {}
        for part in rows:
            x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
            out = x @ params
            out = 1 / (1 + np.exp(-out)) if o.model == "logit" else out
            slope = 2 * (out - part["y"].to_numpy()) * (out * (1 - out) if o.model == "logit" else 1.0)
            for worker, own in part.groupby("worker").indices.items():
                sums[worker] = sums.get(worker, 0) + slope[own] @ x[own]
                counts[worker] = counts.get(worker, 0) + len(own)
        grad = kernels.KERNELS[o.rule](np.stack([sums[w] / counts[w] for w in sorted(sums)]), o.f)
        params, velocity = training.sgd(params, velocity, grad, o.rate, o.momentum, first=step == 0)
        self.state.update((params.tolist(), velocity.tolist(), step + 1))
        yield pd.DataFrame({"run": [key[0]], "step": [step], "grad_norm": [float(np.linalg.norm(grad))], "params": [params.tolist()]})

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "run string, step long, grad_norm double, params array<double>"


def train_on(stream: DataFrame, folder: str, width: int, settings: dict[str, Settings]) -> DataFrame:
    """Training whose steps are the stream's micro-batches of (worker, x, y), of several runs in one query: (run, step, grad_norm, params) of all steps so far.

    Every run sees every batch.  A run's parameters and velocity are keyed
    state, which the checkpoint holds, so a query that was stopped goes on with
    them, and a batch that runs again gives the same.  Results are appended to
    ``folder/out``, each step once.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = stream.select(F.explode(F.array(*map(F.lit, settings))).alias("run"), "worker", "x", "y")
        found = rows.groupBy("run").transformWithStateInPandas(Trainer(width, settings), STEPS, "Append", "None")
        numbers.until_done(found, folder, "append", lambda w: w.format("parquet").option("path", f"{folder}/out"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(STEPS).parquet(f"{folder}/out")
