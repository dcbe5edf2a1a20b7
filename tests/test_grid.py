"""All runs of a grid at once against each run's own loop; stopped and started again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.functions.bounds import RuleError
from steadfold.operators import attacks, grid, training
from steadfold.sources import scratch


def samples(spark):
    random = np.random.default_rng(6)
    rows = [(seed, step, w, random.normal(0, 1, 2).tolist(), float(random.integers(0, 2))) for seed in (0, 1) for step in range(2) for w in range(7) for _ in range(4)]
    return spark.createDataFrame(rows, "seed int, step long, worker int, x array<double>, y double")


def test_twelve_runs_are_twelve_loops(spark):
    rows, made = samples(spark).cache(), {"factor": 1.5}
    settings = [grid.Setting("plain", s, rate=0.3) for s in (0, 1)] + [grid.Setting(f"{rule}-{loss}", seed, rule, f, attack="empire", real=2, attack_options=made, loss=loss, clip=0.2) for rule, f in (("median", 0), ("krum", 2)) for loss in ("mse", "bce+0.1*l2+0.05*l1") for seed in (0, 1)] + [grid.Setting("linear", s, "brute", 2, model="linear", loss="huber", momentum=0.0) for s in (0, 1)]
    folder = scratch.folder(spark)
    assert grid.train(rows, 2, 1, settings, folder).count() == 12
    found = grid.train(rows, 2, 2, settings, folder).collect()
    assert len(found) == 24
    for s in (settings[1], settings[4], settings[8], settings[11]):
        attack = (lambda r: attacks.with_attack(r.withColumn("is_byz", F.lit(False)), "empire", 2, factor=1.5)) if s.attack else None
        own = rows.where(F.col("seed") == s.seed).drop("seed")
        params, log = training.train(own, 2, 2, s.rule, s.f, rate=s.rate, momentum=s.momentum, clip=s.clip, model=s.model, attack=attack, loss=s.loss)
        mine = sorted((r for r in found if (r.name, r.seed) == (s.name, s.seed)), key=lambda r: r.step)
        assert [r.grad_norm for r in mine] == pytest.approx(log["defense_norm"].tolist()) and [r.l2_origin for r in mine] == pytest.approx(log["l2_origin"].tolist())
        assert mine[-1].params == pytest.approx(params.tolist())


def test_settings_that_no_grid_has(spark):
    for wrong in ([grid.Setting("a"), grid.Setting("a")], [grid.Setting("a", rule="none")], [grid.Setting("a", model="mlp")]):
        with pytest.raises(RuleError):
            grid.train(samples(spark), 2, 1, wrong, scratch.folder(spark))
    assert grid.train(samples(spark), 2, 0, [grid.Setting("a")], scratch.folder(spark)).count() == 0
