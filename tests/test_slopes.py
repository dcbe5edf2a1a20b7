"""Gradients of losses: formulas against differences of the losses as they are measured, and training with any of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.functions import losses, slopes
from steadfold.functions.bounds import RuleError
from steadfold.operators import training

PARAMS = np.array([0.4, -0.3, 0.1])


def rows(spark, targets=(0.0, 1.0)):
    random = np.random.default_rng(4)
    return spark.createDataFrame([(0, i % 2, random.normal(0, 1.5, 2).tolist(), float(targets[i % len(targets)])) for i in range(30)], "step int, worker int, x array<double>, y double")


def measured(frame, params, model, loss, classes):
    out = training.outputs(params, model, classes)
    output = out[0] if classes == 1 else F.array(*out)
    target = F.col("y") if classes == 1 else F.col("y").cast("int")
    found = frame.groupBy("worker").agg(loss(output, target, F.array(*map(F.lit, params.tolist()))).alias("l"))
    return np.array([r.l for r in found.orderBy("worker").collect()])


@pytest.mark.parametrize(("model", "loss", "classes", "targets"), [
    ("linear", "mse", 1, (0.0, 1.0)), ("logit", "bce", 1, (0.0, 1.0)), ("linear", "huber", 1, (0.0, 3.0)), ("linear", "bcewithlogits", 1, (0.0, 1.0)), ("linear", "softmargin", 1, (-1.0, 1.0)),
    ("softmax", "nll", 3, (0.0, 1.0, 2.0)), ("linear", "crossentropy", 2, (0.0, 1.0)), ("logit", "0.5*mse + 2*bce + 0.3*l1 + 0.7*l2", 1, (0.0, 1.0)),
])
def test_gradients_by_differences(spark, model, loss, classes, targets):
    frame, params = rows(spark, targets).cache(), np.tile(PARAMS, classes) * np.arange(1, 3 * classes + 1) / 3
    found = training.gradients(frame, params, model, loss, classes).orderBy("worker").collect()
    whole = losses.named(loss)
    assert [r.loss for r in found] == pytest.approx(measured(frame, params, model, whole, classes))
    for k in (0, len(params) - 1):
        step = np.zeros(len(params))
        step[k] = 1e-5
        slope = (measured(frame, params + step, model, whole, classes) - measured(frame, params - step, model, whole, classes)) / 2e-5
        assert [r.g[k] for r in found] == pytest.approx(slope, abs=1e-6)


def test_rules_of_derivation(spark):
    """Each kind of formula at places on both sides of its kinks, against differences."""
    x = slopes.known(F.col("x"))
    made = [x * x / (x + 5), slopes.exp(-x), slopes.log(x + 4, -100), slopes.log(x, -1.0), slopes.log1p(slopes.exp(x)), slopes.sigmoid(2 * x - 1), slopes.absolute(x), 3 - slopes.where(lambda c: c > 0, x, x * x, x), slopes.log_sum_exp([x, -x, slopes.number(1)]), slopes.picked([x, x * x], F.col("at"))]
    places = [(-2.0, 0), (-0.5, 1), (0.25, 0), (3.0, 1)]
    value = spark.createDataFrame(places, "x double, at int").select("x", F.array(*(m.column() for m in made)).alias("v"), F.array(*(m.slope(x).column() for m in made)).alias("d")).collect()
    for sign in (1, -1):
        moved = spark.createDataFrame([(p + sign * 1e-6, k) for p, k in places], "x double, at int").select("x", F.array(*(m.column() for m in made)).alias("v")).collect()
        for a, b in zip(value, moved):
            assert [(q - p) / (sign * 1e-6) for p, q in zip(a.v, b.v)] == pytest.approx(a.d, abs=1e-4)
    assert slopes.known(F.col("y")).slope(x).column() is not None


def test_losses_by_name_and_ones_own(spark):
    for text in ("none", "mse + none", "a*mse"):
        with pytest.raises(RuleError):
            losses.named(text)
    plain = losses.Loss(lambda o, t, p: F.avg(F.abs(o - t)))
    for loss in (plain, plain + losses.LOSSES["mse"]):
        with pytest.raises(RuleError):
            training.gradients(rows(spark), PARAMS, "linear", loss)
    own = losses.of_samples(lambda o, y: slopes.absolute(o[0] - y))
    found = training.gradients(rows(spark), np.array([0.0, 0.0, 10.0]), "linear", own).collect()
    assert all(r.g[2] == 1.0 for r in found)


def test_training_with_other_losses(spark):
    frame = rows(spark).withColumn("y", (F.col("x")[0] > 0).cast("double"))
    steps = frame.drop("step").withColumn("step", F.explode(F.array(*map(F.lit, range(4)))))
    for loss in ("bce", "0.5*mse+bce+0.001*l2"):
        params, _ = training.train(steps, 2, 4, rate=2.0, loss=loss)
        assert params[0] > 0.5
    nothing = training.gradients(frame.limit(0), PARAMS, "logit", "bce")
    assert nothing.count() == 0 and nothing.columns == ["step", "worker", "g", "loss"]
