"""All runs of a grid in one plan: the run is a key beside the step, and a step of all runs is one job.

The state of the runs is a table with a row each: parameters, velocity, and
what the log says of the step.  A step joins it with the step's samples, whose
gradients, attacks and rules are keyed by run and worker, and writes the next
state.  Nothing comes to the driver, and the states of all steps are the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfold.functions.bounds import RuleError
from steadfold.functions.losses import linear, named
from steadfold.functions.vectors import norm
from steadfold.operators import attacks, rules, training
from steadfold.sources import runs


@dataclass(frozen=True)
class Setting:
    """Of one run: a name and a seed, which are its key, the rule against the attack, the model and the optimizer."""

    name: str
    seed: int = 0
    rule: str = "average"
    f: int = 0
    rule_options: dict = field(default_factory=dict)
    attack: str | None = None
    real: int = 0
    attack_options: dict = field(default_factory=dict)
    model: str = "logit"
    loss: str = "mse"
    rate: float = 0.5
    rate_decay: float = 0.0
    rate_every: int = 1
    momentum: float = 0.9
    clip: float | None = None

    def shape(self) -> tuple:
        """What decides the plan; runs of one shape differ in numbers only, which are columns."""
        return (self.rule, self.f, str(sorted(self.rule_options.items())), self.attack, self.real, str(sorted(self.attack_options.items())), self.model, self.loss)


STATE = "name string, seed int, step long, params array<double>, velocity array<double>, loss double, grad_norm double, l2_origin double, rate double, rate_decay double, rate_every long, momentum double, clip double"
_NUMBERS = ("rate", "rate_decay", "rate_every", "momentum", "clip")


def _penalized(found: DataFrame, loss: str) -> DataFrame:
    """Gradients and losses with the penalties of each run's own parameters."""
    for weight, kind in named(loss).penalties:
        size = F.aggregate("params", F.lit(0.0), lambda s, v: s + (F.abs(v) if kind == "l1" else v * v))
        size = F.sqrt(size) if kind == "l2" else size
        slope = (lambda g, p: g + weight * F.signum(p)) if kind == "l1" else (lambda g, p: g + F.when(size > 0, weight * p / size).otherwise(0.0))  # noqa: B023
        found = found.withColumn("g", F.zip_with("g", "params", slope)).withColumn("loss", F.col("loss") + weight * size)
    return found


def _aggregated(samples: DataFrame, state: DataFrame, some: Sequence[Setting], width: int) -> DataFrame:
    """(run, g, loss) of the runs of one shape."""
    o = some[0]
    mine = F.lit(False)
    for s in some:
        mine = mine | ((F.col("name") == s.name) & (F.col("seed") == s.seed))
    mine = state.where(mine).select(F.struct("name", "seed").alias("step"), F.col("seed").alias("of"), "params", "clip")
    # One row a run, so many as there are settings.
    rows = samples.join(F.broadcast(mine), samples["seed"] == F.col("of")).select(mine["step"], "worker", "x", "y", "params")
    weights = linear(F.col("x"), F.slice("params", 1, width), F.col("params")[width])
    found = training.gradients_of(rows, [weights], o.model, named(o.loss), "step", "worker").join(F.broadcast(mine), "step")
    found = _penalized(found, o.loss)
    size = norm(F.col("g"))
    found = found.withColumn("g", F.when(size > F.col("clip"), F.transform("g", lambda v: v * F.col("clip") / size)).otherwise(F.col("g")))
    sent = found.select("step", "worker", "g", F.lit(False).alias("is_byz"))
    if o.attack and o.real:
        sent = sent.unionByName(attacks.made_by(sent, o.attack, o.real, **o.attack_options))
    result = rules.wide_form(rules.aggregate(sent, o.rule, o.f, checked=False, **o.rule_options), "step")
    return result.join(found.groupBy("step").agg(F.avg("loss").alias("loss")), "step").select("step.name", "step.seed", "g", "loss")


def _next(state: DataFrame, found: DataFrame, step: int) -> DataFrame:
    """The state behind a step."""
    first = F.lit(step == 0)
    velocity = F.zip_with("velocity", "g", lambda v, g: F.when(first, g).otherwise(F.col("momentum") * v + g))
    rate = F.when(F.col("rate_decay") > 0, F.col("rate") / (F.floor(F.lit(step) / F.col("rate_every")) * F.col("rate_every") / F.col("rate_decay") + 1)).otherwise(F.col("rate"))
    moved = state.drop("loss", "grad_norm", "l2_origin", "step").join(found, ["name", "seed"]).withColumn("velocity", velocity)
    origin = norm(F.col("params")).alias("l2_origin")  # all runs begin at zero
    params = F.zip_with("params", "velocity", lambda p, v: p - rate * v).alias("params")
    return moved.select("name", "seed", F.lit(step).cast("long").alias("step"), params, "velocity", "loss", norm(F.col("g")).alias("grad_norm"), origin, *_NUMBERS)


def train(samples: DataFrame, width: int, steps: int, settings: Sequence[Setting], folder: str) -> DataFrame:
    """All runs over (seed, step, worker, x, y), each over the rows of its seed: (name, seed, step, params, loss, grad_norm, l2_origin).

    ``params`` are those behind a step; the others are what the step found.
    Each step's state is a table in ``folder`` that counts once it is whole, so
    training that was stopped goes on from its last whole step.
    """
    spark, shapes = samples.sparkSession, {}
    for s in settings:
        shapes.setdefault(s.shape(), []).append(s)
        if s.rule not in rules.RULES or s.attack and s.attack not in attacks.ATTACKS or s.model not in ("linear", "logit"):
            raise RuleError(f"{s.name}: no rule {s.rule}, no attack {s.attack}, or no model {s.model}")
    if len({(s.name, s.seed) for s in settings}) < len(settings):
        raise RuleError("two runs have the same name and seed")
    zero = [0.0] * (width + 1)
    start = [(s.name, s.seed, -1, zero, zero, None, None, None, s.rate, s.rate_decay, s.rate_every, s.momentum, s.clip) for s in settings]
    state = spark.createDataFrame(start, STATE)
    for step in range(steps):
        path = f"{folder}/step={step}"
        if not runs.exists(spark, f"{path}/_SUCCESS"):
            now = samples.where(F.col("step") == step).drop("step")
            found = reduce(DataFrame.unionByName, (_aggregated(now, state, some, width) for some in shapes.values()))
            _next(state, found, step).write.mode("overwrite").parquet(path)
        state = spark.read.schema(STATE).parquet(path)
    if not steps:
        return state.where("step >= 0").select("name", "seed", "step", "params", "loss", "grad_norm", "l2_origin")
    log = spark.read.schema(STATE).parquet(*(f"{folder}/step={k}" for k in range(steps)))
    return log.select("name", "seed", "step", "params", "loss", "grad_norm", "l2_origin")
