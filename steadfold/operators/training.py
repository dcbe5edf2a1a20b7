"""The steps of training by robust aggregation: samples, gradients, noise, updates, and the loop.

Parameters are a short vector on the driver; gradients are sums over samples
that are combined before they are shuffled, one row for each step, worker and
coordinate, and only the aggregated vector comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfold.functions import slopes
from steadfold.functions.bounds import RuleError
from steadfold.functions.losses import Loss, linear, named
from steadfold.functions.slopes import Formula
from steadfold.functions.vectors import NAN
from steadfold.operators.prefix import numbered
from steadfold.operators.rules import aggregate


def split_point(n: int, share: float) -> int:
    """Rows of the training part: of a share below 1 at least one, of a number that many, never all."""
    return min(max(1, int(n * share)) if share < 1 else int(share), n - 1)


def train_test_split(rows: DataFrame, share: float, *order: Column | str) -> DataFrame:
    """``rows`` with ``rn``, the place in the order, and ``part``: train or test."""
    placed = numbered(rows, *order)
    return placed.withColumn("part", F.when(F.col("rn") < split_point(placed.count(), share), "train").otherwise("test"))


def batch_of(rn: Column, size: int, workers: int) -> list[Column]:
    """Of the row at a place of the shuffled order: its batch, step and worker; worker i has batch step * workers + i."""
    batch = F.floor(rn / size)
    return [batch.cast("long").alias("batch"), F.floor(batch / workers).cast("long").alias("step"), (batch % workers).cast("long").alias("worker")]


def test_cursor(rows: int, size: int, batch: Column) -> Column:
    """Where a sequential cursor that starts anew at the end stands before a batch."""
    per_round = math.ceil(rows / size)
    return (batch % per_round) * size


def source_batch(batch: Column, batches: int) -> Column:
    """Which batch of a source that starts anew at its end is the next one; a source without batches is refused."""
    if batches < 1:
        raise RuleError("a source without batches can't be sampled from")
    return F.pmod(batch, F.lit(batches))


#: Models as formulas: the outputs of what the weights make of a sample, one number for each class.
OUTPUTS: dict[str, Callable[[list[Formula]], list[Formula]]] = {
    "linear": lambda z: z,
    "logit": lambda z: [slopes.sigmoid(x) for x in z],
    "softmax": lambda z: [x - slopes.log_sum_exp(z) for x in z],
}


def _sums(params: np.ndarray, classes: int) -> list[Column]:
    """What each class's weights and bias make of ``x``."""
    each = np.asarray(params, float).reshape(classes, -1)
    return [linear(F.col("x"), F.array(*map(F.lit, w[:-1].tolist())), F.lit(float(w[-1]))) for w in each]


def outputs(params: np.ndarray, model: str, classes: int = 1) -> list[Column]:
    """The outputs of a model for ``x``, one for each class; ``softmax`` gives logarithms."""
    return [o.column() for o in OUTPUTS[model]([slopes.known(z) for z in _sums(params, classes)])]


def gradients_of(samples: DataFrame, sums: list[Column], model: str, loss: Loss, *keys: str) -> DataFrame:
    """(keys, x, y, ...) -> (keys, g, loss), of the samples' part of a loss, by the sums that the weights make of ``x``.

    A sample's slopes by its sums come from the loss's own formula; what is left
    is a product with x, and a mean.
    """
    if model not in OUTPUTS or not loss.trainable:
        raise RuleError(f"no model {model}, or no formula of the loss to train with")
    names = [f"z{k}" for k in range(len(sums))]
    z = [slopes.known(F.col(n)) for n in names]
    out = OUTPUTS[model](z)
    whole = reduce(lambda a, b: a + b, (w * term(out, F.col("y")) for w, term in loss.terms)) if loss.terms else slopes.number(0)
    summed = samples.select(*keys, "x", "y", *(c.alias(n) for c, n in zip(sums, names, strict=True)))
    sloped = summed.select(*keys, F.concat("x", F.array(F.lit(1.0))).alias("x"), whole.column().alias("loss"), F.array(*(whole.slope(v).column() for v in z)).alias("s"))
    each = sloped.select(*keys, "loss", F.posexplode(F.flatten(F.transform("s", lambda s: F.transform("x", lambda x: s * x)))).alias("pos", "v"))
    means = each.groupBy(*keys, "pos").agg(F.avg("v").alias("val"), F.avg("loss").alias("loss"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "val")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda x: x["val"]).alias("g"), F.min_by("loss", "pos").alias("loss"))


def gradients(samples: DataFrame, params: np.ndarray, model: str, loss: str | Loss = "mse", classes: int = 1) -> DataFrame:
    """(step, worker, x, y) -> (step, worker, g, loss): of any loss that can be trained with, by its name, as a sum, or as such.

    ``linear`` and ``logit`` have one output, ``softmax`` the logarithms of
    ``classes`` probabilities, for a target that counts classes from 0.  A
    class's bias comes behind its weights, and classes one after the other.
    """
    loss = named(loss) if isinstance(loss, str) else loss
    found = gradients_of(samples, _sums(params, classes), model, loss, "step", "worker")
    more, by = penalty(np.asarray(params, float), loss)
    if not loss.penalties:
        return found
    return found.withColumn("g", F.zip_with("g", F.array(*map(F.lit, by.tolist())), lambda a, b: a + b)).withColumn("loss", F.col("loss") + more)


def penalty(params: np.ndarray, loss: Loss) -> tuple[float, np.ndarray]:
    """What a loss's penalties come to, and their slopes; those of the norm at zero are zero."""
    size = float(np.linalg.norm(params))
    parts = {"l1": (float(np.abs(params).sum()), np.sign(params)), "l2": (size, params / size if size else np.zeros_like(params))}
    return sum(w * parts[k][0] for w, k in loss.penalties), sum((w * parts[k][1] for w, k in loss.penalties), np.zeros_like(params))


def privacy_sigma(clip: float, batch: int, epsilon: float, delta: float) -> float:
    """The deviation of the noise that makes clipped gradients (epsilon, delta)-private."""
    if not 0 < epsilon < 1 or not 0 < delta < 1:
        raise RuleError("epsilon and delta must be within 0 and 1")
    return 2 * clip / batch * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def privacy_deviation(clip: float, batch: Column, epsilon: Column, delta: float) -> Column:
    """The same for batches and epsilons of a table; null where an epsilon isn't within 0 and 1."""
    if not 0 < delta < 1:
        raise RuleError("delta must be within 0 and 1")
    return F.when((epsilon > 0) & (epsilon < 1), 2 * clip / batch * math.sqrt(2 * math.log(1.25 / delta)) / epsilon)


def with_noise(rows: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise on every coordinate, drawn from hashes, so that a task that runs again draws the same."""
    uniform = lambda i, salt: (F.pmod(F.xxhash64("step", "worker", i, F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda i: F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))
    return rows.withColumn("g", F.transform("g", lambda x, i: x + sigma * normal(i)))


def learning_rate(step: Column, rate: float, decay: float, every: int) -> Column:
    """Constant within ``every`` steps; constant at all if ``decay`` isn't positive."""
    return F.lit(float(rate)) if decay <= 0 else F.lit(float(rate)) / (F.floor(step / every) * every / F.lit(float(decay)) + 1)


def sgd(params: np.ndarray, velocity: np.ndarray, grad: np.ndarray, rate: float, momentum: float = 0.0, dampening: float = 0.0, decay: float = 0.0, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """One step of gradient descent: the new parameters and velocity."""
    grad = grad + decay * params
    velocity = grad if first or not momentum else momentum * velocity + (1 - dampening) * grad
    return params - rate * velocity, velocity


def train(samples: DataFrame, width: int, steps: int, rule: str = "average", f: int = 0, rate: float = 0.01, momentum: float = 0.9, clip: float | None = None, sigma: float = 0.0, seed: int = 0, model: str = "logit", attack: Callable[[DataFrame], DataFrame] | None = None, loss: str | Loss = "mse") -> tuple[np.ndarray, pd.DataFrame]:
    """Train on (step, worker, x, y): the parameters, and a log (step, l2_origin, defense_norm).

    One job a step; the driver holds the parameters and a vector as long.
    """
    from steadfold.functions.vectors import clipped

    origin = params = np.zeros(width + 1)
    velocity, log = np.zeros(width + 1), []
    for step in range(steps):
        grads = gradients(samples.where(F.col("step") == step), params, model, loss).drop("loss")
        grads = grads if clip is None else grads.withColumn("g", clipped(F.col("g"), clip))
        grads = with_noise(grads, sigma, seed) if sigma else grads
        result = aggregate(attack(grads) if attack else grads, rule, f, checked=step == 0)
        grad = np.array([r.val for r in result.orderBy("pos").select("val").collect()])
        log.append((step, float(np.linalg.norm(params - origin)), float(np.linalg.norm(grad)) if len(grad) else NAN))
        params, velocity = sgd(params, velocity, grad, rate, momentum, first=step == 0)
    return params, pd.DataFrame(log, columns=["step", "l2_origin", "defense_norm"])


def regression(rows: DataFrame, width: int, steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights and bias that minimise the squared error of (x, y), by Adam on the driver over sums of products.

    Products of coordinates are summed once, so the number of rows doesn't
    matter to the loop; it has width + 2 squared numbers at most.
    """
    full = F.concat("x", F.array(F.lit(1.0), F.col("y")))
    cells = rows.select(F.posexplode(full).alias("i", "a"), full.alias("f")).select("i", "a", F.posexplode("f").alias("j", "b"))
    table = np.zeros((width + 2, width + 2))
    for i, j, v in cells.groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b"))).collect():
        table[i, j] = v
    xx, xy = table[: width + 1, : width + 1], table[: width + 1, width + 1]
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = 2 * (xx @ w - xy)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w
