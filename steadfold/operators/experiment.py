"""A training run as a whole, and many of them: settings, the loop, logs, evaluation, checkpoints, and averages over seeds.

A step is three small jobs: the honest vectors are written, the rule's result
comes to the driver, and so does the step's row of the study log.  Parameters
and what the optimizer remembers stay on the driver.  Logs are written in parts,
which are committed together with a checkpoint, so a run that was stopped goes
on from its last commit and no row is there twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.functions import losses
from steadfold.functions.bounds import RuleError
from steadfold.functions.vectors import clipped
from steadfold.operators import attacks, metrics, networks, optimizers, rules, training
from steadfold.sources import runs, scratch
from steadfold.sources.checkpoint import Checkpoint
from steadfold.sources.commits import Commits
from steadfold.sources.dataset import Batches


@dataclass(frozen=True)
class Options:
    """The settings of a run.  Values that are given here are fixed values: what a run takes without others."""

    steps: int = 300
    workers: int = 11
    declared: int = 4
    real: int = 0
    rule: str = "average"
    rule_options: dict = field(default_factory=dict)
    attack: str = "nan"
    attack_options: dict = field(default_factory=dict)
    model: str = "logit"
    model_options: dict = field(default_factory=dict)
    loss: str = "mse"
    criterion: str = "sigmoid"
    optimizer: str = "sgd"
    momentum: float = 0.9
    dampening: float = 0.0
    weight_decay: float = 0.0
    rate: float = 0.01
    rate_decay: float = 5000
    rate_every: int = 5000
    clip: float | None = 5.0
    privacy: bool = False
    epsilon: float = 0.5
    delta: float = 0.5
    l1: float = 0.0
    l2: float = 0.0
    batch: int = 25
    test_batch: int = 100
    test_repeat: int = 100
    evaluate_every: int = 100
    seed: int = 1
    initial: str = "zeros"

    @property
    def honest(self) -> int:
        return self.workers - self.real

    @property
    def by_columns(self) -> bool:
        """Whether the model is a formula over columns, which any loss can train, or a network."""
        return self.model in training.OUTPUTS and not self.model_options


def checked(options: Options) -> Options:
    """Raise RuleError for settings that no run can have."""
    if not 0 <= options.real <= options.declared <= options.workers or options.honest < 1:
        raise RuleError("real workers that are arbitrary can't be more than declared ones, nor these more than all, and one must be honest")
    if options.rule not in rules.RULES or options.attack not in attacks.ATTACKS:
        raise RuleError(f"no rule {options.rule} or no attack {options.attack}")
    if options.model not in networks.MODELS or options.optimizer not in optimizers.OPTIMIZERS:
        raise RuleError(f"no model {options.model}, or no optimizer {options.optimizer}")
    if options.by_columns and not losses.named(options.loss).trainable or not options.by_columns and options.loss not in networks.OUTPUT_LOSSES:
        raise RuleError(f"{options.model} can't be trained with {options.loss}")
    return options


@dataclass
class Result:
    params: np.ndarray
    study: list[tuple]
    evaluation: list[tuple[int, float]]
    seconds: dict[str, float]


class _Run:
    def __init__(self, train: Batches, test: Batches, width: int, options: Options) -> None:
        self.train, self.test, self.options, self.spark = train, test, checked(options), train.placed.sparkSession
        o = options
        self.by_columns = o.by_columns
        self.network = networks.MODELS[o.model](**({"inputs": width} | o.model_options if o.model in ("linear", "logit") else o.model_options))
        self.params = optimizers.initial(self.network.shapes, o.initial, "zeros", o.seed)
        more = {"momentum": o.momentum, "dampening": o.dampening} if o.optimizer == "sgd" else {}
        self.optimizer = optimizers.optimizer(o.optimizer, rate=o.rate, decay=o.weight_decay, **more)
        self.origin = self.params.copy()
        self.sigma = training.privacy_sigma(o.clip or 1.0, o.batch, o.epsilon, o.delta) if o.privacy else 0.0
        self.seconds = dict.fromkeys(("grad", "aggr", "eval"), 0.0)

    def output(self) -> Column:
        return training.outputs(self.params, self.options.model)[0]

    def honest(self, step: int) -> DataFrame:
        """(step, worker, g, loss) of the honest workers, before noise; worker i has batch step * honest + i."""
        o = self.options
        samples = self.train.spread(step * o.honest, o.honest).select(F.lit(step).cast("long").alias("step"), F.col("slot").cast("int").alias("worker"), "x", "y")
        if self.by_columns:
            found = training.gradients(samples, self.params, o.model, o.loss)
        else:
            found = networks.gradients(samples, self.network, self.params, o.loss)
        if o.l1 or o.l2:
            norm = float(np.linalg.norm(self.params))
            more = o.l1 * np.sign(self.params) + (o.l2 * self.params / norm if norm else 0.0)
            found = found.withColumn("g", F.zip_with("g", F.array(*map(F.lit, more.tolist())), lambda a, b: a + b))
            found = found.withColumn("loss", F.col("loss") + float(o.l1 * np.abs(self.params).sum() + o.l2 * norm))
        return found if o.clip is None else found.withColumn("g", clipped(F.col("g"), o.clip))

    def step(self, step: int) -> tuple:
        """Take one step; the step's row of the study log, in the order of its columns."""
        o, since = self.options, time.time()
        rows = self.honest(step)
        rows.write.parquet(path := scratch.folder(self.spark, "vectors"))
        rows = self.spark.read.schema(rows.schema).parquet(path).select("step", "worker", "g", "loss", F.lit(False).alias("is_byz"))
        self.seconds["grad"] += time.time() - since

        since = time.time()
        sent = (training.with_noise(rows, self.sigma, o.seed) if self.sigma else rows).select("step", "worker", "g", "is_byz")
        made = attacks.made_by(sent, o.attack, o.real, **o.attack_options) if o.real else None
        every = sent if made is None else sent.unionByName(made)
        found = rules.aggregate(every, o.rule, o.declared, checked=step == 0, **o.rule_options).orderBy("pos").collect()
        grad = np.array([r.val for r in found])
        self.seconds["aggr"] += time.time() - since

        plain = rows.drop("loss")
        result = self.spark.createDataFrame([(step, i, float(v)) for i, v in enumerate(grad)], "step long, pos int, val double")
        study = metrics.study(plain if made is None else plain.unionByName(made), result, o.batch).join(rows.groupBy("step").agg(F.avg("loss").alias("loss_avg")), "step").first().asDict()
        study["l2_origin"] = float(np.linalg.norm(self.params - self.origin))
        if o.rate_decay > 0 and step % o.rate_every == 0:
            self.optimizer.rate = o.rate / (step / o.rate_decay + 1)
        self.params = self.optimizer.step(self.params, grad)
        scratch.drop(self.spark, path)
        return tuple(study[c.split()[0]] for c in runs.STUDY.split(", "))

    def accuracy(self, number: int) -> float:
        """The share of right outputs over the next ``test_repeat`` testing batches."""
        o, since = self.options, time.time()
        first, batches, per = number * o.test_repeat, o.test_repeat, self.test.round
        # How often a batch of a round is among these: whole rounds, and the rest.
        q = F.floor(F.col("rn") / self.test.size)
        times = (F.floor((first + batches - 1 - q) / per) - F.floor((first - 1 - q) / per)).cast("long")
        rows = self.test.placed.withColumn("times", times).where("times > 0")
        if self.by_columns:
            right = rows.withColumn("out", F.array(self.output()))
        else:
            outputs = networks.predict(rows.select(F.struct("rn", "y", "times").alias("id"), "x"), self.network, self.params)
            right = outputs.select("id.*", "out")
        kind, _, k = o.criterion.partition(":")
        hit = losses.in_top_k(F.col("out"), F.col("y").cast("int"), int(k or 1)) if kind == "top-k" else losses.sigmoid_right(F.col("out")[0], F.col("y"))
        found = right.agg(F.sum(hit * F.col("times")).alias("right"), F.sum("times").alias("all")).first()
        self.seconds["eval"] += time.time() - since
        return found.right / found.all


#: Settings that a run may go on with changed.
FREE = ("steps",)


def _same_settings(folder: str, options: Options, kept: dict) -> None:
    now = json.loads(json.dumps(asdict(options)))
    other = sorted(k for k in now if k not in FREE and now[k] != kept.get(k))
    if other:
        raise RuleError(f"{folder} has a run with other settings: {', '.join(f'{k} is {kept.get(k)!r} there, not {now[k]!r}' for k in other)}")


def run(train: Batches, test: Batches, width: int, options: Options, folder: str | None = None, stop: Callable[[int], bool] | None = None) -> Result:
    """Train, evaluating before every ``evaluate_every``-th step and after the last one.

    ``train`` and ``test`` have x (arrays of ``width`` doubles) and y.  With a
    ``folder`` the settings are written there, and at each evaluation what the
    logs have since the last one, with a checkpoint: one commit, see
    ``sources.commits``, so a run that dies at any time goes on from the last
    commit, and each row is there once.  A run with other settings than the
    folder's, but for the number of steps, is refused.  ``stop`` is asked before
    each step; a path ``stop`` in the folder stops the run too.
    """
    spark, state, study, evaluation, step, judged = train.placed.sparkSession, _Run(train, test, width, options), [], [], 0, -1
    commits = Commits(spark, folder) if folder else None
    last = commits.last() if commits else None
    if last:
        _same_settings(folder, options, last["settings"])
        kept = Checkpoint().load(spark, f"{folder}/{last['checkpoint']}").restore("run")
        step, judged, state.params = int(kept["step"]), int(kept["judged"]), kept["params"]
        state.optimizer.memory, state.optimizer.rate = kept["memory"], kept["rate"]
    elif folder:
        runs.write_json(spark, asdict(options), f"{folder}/config.json")
    written = [0, 0]

    def flush() -> None:
        if not commits or [len(study), len(evaluation)] == written:
            return
        parts: dict[str, object] = {"settings": asdict(options), "step": step, "checkpoint": commits.place("checkpoint")}
        for k, (name, rows, schema) in enumerate((("study", study, runs.STUDY), ("eval", evaluation, runs.EVAL))):
            if rows[written[k] :]:
                parts[name] = commits.place(name)
                runs.write(spark.createDataFrame(rows[written[k] :], schema).coalesce(1), f"{folder}/{parts[name]}")
        now = {"step": step, "judged": judged, "params": state.params, "memory": state.optimizer.memory, "rate": state.optimizer.rate}
        Checkpoint().snapshot("run", now).save(spark, f"{folder}/{parts['checkpoint']}")
        commits.commit(parts)
        written[:] = len(study), len(evaluation)
        commits.forget("checkpoint", 2)

    every = options.evaluate_every
    while True:
        ended = options.steps > 0 and step >= options.steps
        if every > 0 and step % every == 0 and step > judged:
            flush()
            evaluation.append((step, state.accuracy(step // every)))
            judged = step
        if ended or stop and stop(step) or folder and runs.exists(spark, f"{folder}/stop"):
            break
        study.append(state.step(step))
        step += 1
    flush()
    if folder:
        runs.write_json(spark, state.seconds, f"{folder}/perfs.json")
    return Result(state.params, study, evaluation, state.seconds)


def named(settings: dict[str, object]) -> str:
    return "-".join(f"{k}_{v}" for k, v in settings.items())


def grid(train: Callable[[Options], Batches], test: Callable[[Options], Batches], width: int, base: Options, settings: Iterable[dict[str, object]], folder: str, seeds: Iterable[int] = range(1, 6), together: int = 1) -> list[tuple[str, int, str]]:
    """Run every setting with every seed into ``folder/name/seed``: (name, seed, done or what went wrong).

    A run that is done is skipped, one that was stopped goes on, and one that
    fails doesn't keep the others from running.  ``together`` runs share the
    cluster at a time.
    """
    seeds = list(seeds)

    def one(job: tuple[dict[str, object], int]) -> tuple[str, int, str]:
        changed, seed = job
        options, path = replace(base, **changed, seed=seed), f"{folder}/{named(changed)}/{seed}"
        try:
            batches = train(options)
            if not runs.exists(batches.placed.sparkSession, f"{path}/perfs.json"):
                run(batches, test(options), width, options, path)
            return named(changed), seed, "done"
        except Exception as error:  # noqa: BLE001 - whatever it is, it is one run's, and is reported
            return named(changed), seed, f"{type(error).__name__}: {error}"

    jobs = [(changed, seed) for changed in settings for seed in seeds]
    if together == 1:
        return [one(job) for job in jobs]
    with ThreadPoolExecutor(together) as pool:
        return list(pool.map(one, jobs))


def averaged(spark: SparkSession, folder: str, settings: Iterable[dict[str, object]], seeds: Iterable[int], *columns: str) -> DataFrame:
    """(name, step, seeds, and of each column its mean and deviation over the seeds) of the runs of a grid."""
    seeds, parts = list(seeds), []
    for changed in settings:
        each = reduce(DataFrame.unionByName, (runs.Session(spark, f"{folder}/{named(changed)}/{seed}").data for seed in seeds))
        parts.append(runs.over_seeds(each, *columns).withColumn("name", F.lit(named(changed))))
    return reduce(DataFrame.unionByName, parts)


def options_of(text: str) -> Options:
    """Options from the JSON of a run's settings."""
    return Options(**json.loads(text))
