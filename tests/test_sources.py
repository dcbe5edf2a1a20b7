import math

import pytest
from pyspark.sql import functions as F

from steadfold.functions import losses
from steadfold.sources import libsvm, runs
from steadfold.streaming import batches


def test_libsvm(spark):
    rows = spark.createDataFrame([("1 1:0.5 3:-2",), ("-1",), ("0 2:1e3",), ("1 3:1 2:5 3:2 9:9 0:4",)], "line string")
    found = [tuple(r.r) for r in rows.select(libsvm.parse(F.col("line"), 3).alias("r")).collect()]
    assert found == [(1.0, [0.5, 0.0, -2.0]), (0.0, [0.0, 0.0, 0.0]), (0.0, [0.0, 1000.0, 0.0]), (1.0, [0.0, 5.0, 2.0])]


def test_log_with_a_header(spark, tmp_path):
    (tmp_path / "eval").write_text("# Step number\tCross-accuracy\n0\t0.5\n100\t7.5e-01")
    assert [tuple(r) for r in runs.read(spark, str(tmp_path / "eval"), runs.EVAL).orderBy("step").collect()] == [(0, 0.5), (100, 0.75)]


def test_seeds_leave_out_what_is_missing(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, math.nan), (1, None), (1, 5.0)], "step long, v double")
    found = {r.step: (r.seeds, r.v_avg, r.v_err) for r in runs.over_seeds(rows, "v").collect()}
    assert found == {0: (2, 2.0, 1.0), 1: (1, 5.0, 0.0)}


def test_histogram_of_nothing_and_of_one_value(spark):
    assert runs.histogram(spark.createDataFrame([], "v double"), "v").count() == 0
    found = runs.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in found] == [2, 0, 0, 0]


def test_columns_by_name(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "Step int, lossAvg int, Accuracy int")
    assert runs.select_like(rows, "acc", "S").columns == ["Accuracy", "Step", "lossAvg"]
    assert runs.discard_like(rows, "LOSS").columns == ["Step", "Accuracy"]


def test_keyvals(spark):
    row = spark.sql("SELECT array('lr:0.01', 'n:-3', 'on:TRUE', 'name:a:b') AS w").select(runs.parse_keyval(F.col("w")).alias("p")).first()
    assert [tuple(p) for p in row.p] == [("lr", "float", "0.01"), ("n", "int", "-3"), ("on", "bool", "TRUE"), ("name", "str", "a:b")]


def test_losses(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "p double, y double")
    assert rows.agg(losses.bce(F.col("p"), F.col("y"))).first()[0] == pytest.approx(50)
    top = spark.sql("SELECT array(0.1D, 0.9D, 0.9D) AS x")
    assert [top.select(losses.in_top_k(F.col("x"), F.lit(t), 1)).first()[0] for t in range(3)] == [0, 1, 0]


def test_windows_of_events(spark):
    rows = spark.sql("SELECT timestamp '2024-01-01 10:00:00' AS ts, 1L AS user_id, 2D AS value UNION ALL SELECT timestamp '2024-01-01 11:00:00', 2L, 4D")
    found = batches.windowed(rows).first()
    assert (found.n, found.mean, found.median) == (2, 3.0, 2.0)
