"""Streams: windows against DuckDB, numbered batches against the batches themselves, keyed training against the loop; all of them stopped and started again."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from steadfold.operators import training
from steadfold.plans import data
from steadfold.sources import dataset, scratch
from steadfold.streaming import batches, numbers

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_window_is_there(spark):
    events, folder = spark.read.parquet(f"{SF}/events.parquet"), scratch.folder(spark)
    part = batches.windowed_stream(events, folder, 5, last=2).count()
    found = batches.windowed_stream(events, folder, 5).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "mean", "median").orderBy("day").collect()
    expected = duckdb.sql(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FROM '{SF}/events.parquet' GROUP BY day ORDER BY day").fetchall()
    assert [(r.day, r.n) for r in found] == expected and 0 < part < len(found)
    each = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.expr("pmod(user_id, 16)").alias("worker")).agg(F.avg("value").alias("v"))
    days = {}
    for r in each.collect():
        days.setdefault(r.day, []).append(r.v)
    for r in found:
        values = sorted(days[r.day])
        assert (r.mean, r.median) == pytest.approx((sum(values) / len(values), values[(len(values) - 1) // 2]))


def test_numbered_batches_go_on(spark):
    """Some batches, a stop, and the others, over the end of the table: each is what the table gives for its number."""
    rows = spark.range(37).select(F.col("id").alias("key"), (F.col("id") * 3).alias("v"))
    for wraps in (True, False):
        table, folder = dataset.Batches(rows, 10, "key", wraps=wraps), scratch.folder(spark)
        for last in (3, 3, 8):
            stream = numbers.sampled(table, folder, last, per=2)
            numbers.until_done(stream, folder, "append", lambda w, folder=folder: w.format("parquet").option("path", f"{folder}/out"))
            assert numbers.begun(spark, folder) == last
        found = {}
        for r in spark.read.parquet(f"{folder}/out").collect():
            found.setdefault(r.batch, []).append((r.key, r.v))
        assert sorted(found) == list(range(8))
        for k in (0, 2, 3, 7):
            assert sorted(found[k]) == sorted(map(tuple, table.sample(k).collect()))
    with pytest.raises(ValueError, match="without rows"):
        numbers.numbers(spark, scratch.folder(spark), 0, 5, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_training_goes_on_after_a_stop(spark):
    """Two steps, a stop, three more, of two runs in one query: the same as each run's loop."""
    rows, folder = data.samples(spark, SF), scratch.folder(spark)
    settings = {"a": batches.Settings("median", 0, 0.5, 0.9), "b": batches.Settings("krum", 2, 0.2, 0.0)}
    assert batches.train_on(numbers.by_step(rows, folder, 2), folder, 4, settings).count() == 4
    found = batches.train_on(numbers.by_step(rows, folder, 5), folder, 4, settings).orderBy("run", "step").collect()
    assert [(r.run, r.step) for r in found] == [(k, s) for k in "ab" for s in range(5)]
    for k, o in settings.items():
        params, log = training.train(rows, 4, 5, o.rule, o.f, rate=o.rate, momentum=o.momentum)
        own = [r for r in found if r.run == k]
        assert [r.grad_norm for r in own] == pytest.approx(log["defense_norm"].tolist()) and own[-1].params == pytest.approx(params.tolist())
