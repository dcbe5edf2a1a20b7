"""Networks, optimizers, batches, checkpoints, and runs that are stopped and go on."""

import dataclasses
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.__main__ import options_of
from steadfold.functions import losses
from steadfold.functions.bounds import RuleError
from steadfold.operators import experiment, networks, optimizers
from steadfold.sources import checkpoint, commits, dataset, images, runs


@pytest.mark.parametrize(("network", "loss"), [(networks.full(4, 5, 3), "nll"), (networks.conv(10, (2, 3), 3, 4, 3), "nll"), (networks.MODELS["logit"](16, 2), "mse"), (networks.MODELS["linear"](16), "mse")])
def test_gradients_by_differences(network, loss):
    random = np.random.default_rng(1)
    params = optimizers.initial(network.shapes, "xavier_normal", "normal", 2)
    inputs = 100 if isinstance(network.layers[0], networks.Convolution) else 16
    x = random.normal(0, 1, (6, inputs))
    y = random.integers(0, 3, 6) if loss == "nll" else random.normal(0, 1, (6, network.layers[0].outputs))
    value, grad = network.loss_and_gradient(params, x, y, loss)
    assert len(grad) == len(params) and value > 0
    for k in random.permutation(len(params))[:25]:
        around = []
        for by in (1e-5, -1e-5):
            moved = params.copy()
            moved[k] += by
            around.append(network.loss_and_gradient(moved, x, y, loss)[0])
        assert (around[0] - around[1]) / 2e-5 == pytest.approx(grad[k], rel=1e-3, abs=1e-5)


def test_convolution_and_pool_against_loops():
    random = np.random.default_rng(2)
    x, layer = random.normal(0, 1, (2, 3, 5, 5)), networks.Convolution(3, 4, 2)
    w, b = random.normal(0, 1, (4, 3, 2, 2)), random.normal(0, 1, 4)
    out, _ = layer.forward(x, w, b)
    plain = [[[[sum(x[n, c, i + p, j + q] * w[o, c, p, q] for c in range(3) for p in range(2) for q in range(2)) + b[o] for j in range(4)] for i in range(4)] for o in range(4)] for n in range(2)]
    assert np.allclose(out, plain)
    pooled, _ = networks.Pool().forward(x)
    assert pooled.shape == (2, 3, 2, 2) and pooled[1, 2, 1, 0] == x[1, 2, 2:4, 0:2].max()
    assert networks.conv().shapes == [(20, 1, 5, 5), (20,), (50, 20, 5, 5), (50,), (500, 800), (500,), (10, 500), (10,)]


def test_network_gradients_are_means_over_workers(spark):
    network, random = networks.full(2, 3, 2), np.random.default_rng(3)
    params = optimizers.initial(network.shapes, seed=1)
    x, y = random.normal(0, 1, (40, 4)), random.integers(0, 2, 40)
    rows = spark.createDataFrame([(0, i % 3, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "step long, worker int, x array<double>, y double")
    for r in networks.gradients(rows.repartition(5), network, params, "nll").collect():
        own = np.arange(40) % 3 == r.worker
        value, grad = network.loss_and_gradient(params, x[own], y[own], "nll")
        assert r.g == pytest.approx(grad / own.sum()) and r.loss == pytest.approx(value / own.sum())


def test_optimizers_by_hand():
    start, grad = np.array([1.0, -2.0]), np.array([0.5, 0.25])
    sgd = optimizers.optimizer("sgd", rate=0.1, momentum=0.9, dampening=0.5)
    one = sgd.step(start, grad)
    assert one == pytest.approx(start - 0.1 * grad) and sgd.step(one, grad) == pytest.approx(one - 0.1 * (0.9 * grad + 0.5 * grad))
    assert optimizers.optimizer("sgd", rate=0.1, decay=0.1).step(start, grad) == pytest.approx(start - 0.1 * (grad + 0.1 * start))
    assert optimizers.optimizer("adam", rate=0.1).step(start, grad) == pytest.approx(start - 0.1, abs=1e-6)
    assert optimizers.optimizer("adagrad", rate=0.1).step(start, grad) == pytest.approx(start - 0.1, abs=1e-6)
    assert optimizers.optimizer("rmsprop", rate=0.1).step(start, grad) == pytest.approx(start - 1.0, abs=1e-5)
    with pytest.raises(RuleError):
        optimizers.optimizer("none")
    with pytest.raises(RuleError):
        optimizers.register(optimizers.OPTIMIZERS, "sgd", optimizers.Sgd)


def test_initialisers():
    for name in optimizers.INITIALISERS:
        assert optimizers.initial([(6, 6), (6,)], name, "ones", 1).shape == (42,)
    wide = optimizers.initial([(400, 100)], "kaiming_uniform", seed=2)
    assert np.abs(wide).max() <= np.sqrt(6 / 100) and wide.std() == pytest.approx(np.sqrt(2 / 100), rel=0.05)
    q = optimizers.initial([(5, 3)], "orthogonal", seed=3).reshape(5, 3)
    assert q.T @ q == pytest.approx(np.eye(3), abs=1e-9)
    assert (optimizers.initial([(2, 2)], "xavier_normal", seed=4) == optimizers.initial([(2, 2)], "xavier_normal", seed=4)).all()


def test_losses_of_ones_own_and_twice_multiplied(spark):
    rows = spark.createDataFrame([(2.0, 0.0)], "p double, y double")
    of = lambda loss: rows.agg(loss(F.col("p"), F.col("y"), F.array("p"))).first()[0]
    assert of(losses.LOSSES["mse"] * 3) == 12 and of(losses.LOSSES["mse"].times(3, compat=True)) == 36
    losses.register("gap", losses.Loss(lambda o, t, p: F.avg(F.abs(o - t))))
    try:
        assert of(losses.LOSSES["gap"] + losses.LOSSES["huber"]) == 3.5
        with pytest.raises(RuleError):
            losses.register("gap", losses.LOSSES["mse"])
    finally:
        del losses.LOSSES["gap"]


def test_batches(spark):
    rows = spark.range(10).selectExpr("id AS v")
    train = dataset.Batches(rows, 4, "v")
    values = lambda df: sorted(r.v for r in df.collect())
    assert [values(train.sample(k)) for k in range(6)] == [[0, 1, 2, 3], [4, 5, 6, 7], [0, 1, 8, 9], [2, 3, 4, 5], [6, 7, 8, 9], [0, 1, 2, 3]]
    spread = sorted((r.slot, r.v) for r in train.spread(1, 6).collect())
    assert [v for _, v in spread] == [v for k in range(1, 7) for v in values(train.sample(k))]
    assert [s for s, _ in spread] == [k for k in range(6) for _ in range(4)]
    test = dataset.Batches(rows, 4, "v", wraps=False)
    assert [values(test.sample(k)) for k in range(4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2, 3]]
    assert values(dataset.Batches(rows, 0, "v").sample(3)) == list(range(10))
    assert sorted((r.batch, r.v) for r in train.epoch().collect()) == [(v // 4, v) for v in range(10)]
    with pytest.raises(ValueError, match="no rows"):
        dataset.Batches(rows.limit(0), 4, "v")
    one, other = dataset.datasets(rows, 0.7, 3, 2, "v")
    assert (one.n, other.n, values(other.epoch())) == (7, 3, [7, 8, 9])


def test_checkpoints_guard_what_is_there(spark, tmp_path):
    state = {"a": np.arange(6.0).reshape(2, 3), "n": np.int64(3), "deep": [1, "x", None, {"b": True}]}
    kept = checkpoint.Checkpoint().snapshot("one", state)
    state["a"][0, 0] = 9
    with pytest.raises(KeyError):
        kept.snapshot("one", 1)
    with pytest.raises(KeyError):
        kept.restore("two")
    kept.save(spark, f"file://{tmp_path}/c")
    with pytest.raises(Exception, match="(?i)exist"):
        kept.save(spark, f"file://{tmp_path}/c")
    kept.save(spark, f"file://{tmp_path}/c", overwrite=True)
    found = checkpoint.Checkpoint().load(spark, f"file://{tmp_path}/c").restore("one")
    assert found["a"][0, 0] == 0 and found["a"].shape == (2, 3) and found["n"] == 3 and found["deep"] == [1, "x", None, {"b": True}]
    with pytest.raises(KeyError):
        kept.load(spark, f"file://{tmp_path}/c")
    store = checkpoint.Storage(a=1)
    store.b = 2
    assert store.a + store["b"] == 3 and not hasattr(store, "c")


def test_flips(spark):
    rows = spark.range(200).select("id", F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))).alias("x"))
    found = [r.x for r in rows.select(images.flipped_at_random(F.col("x"), 3, "id").alias("x")).collect()]
    assert 60 < sum(x == [3, 2, 1, 6, 5, 4] for x in found) < 140 and all(x in ([3, 2, 1, 6, 5, 4], [1, 2, 3, 4, 5, 6]) for x in found)


def test_images():
    assert images.pnm(np.array([0.0, 1.0, 0.5, 0.25]), 2) == b"P5\n2 2\n255\n" + bytes([0, 255, 127, 63])
    assert images.pnm(np.array([0.0, 1.0] * 5), 10, bits=True) == b"P4\n10 1\n" + bytes([0b01010101, 0b01000000])
    assert images.pnm(np.array([np.nan, 7.0]), 2) == b"P5\n2 1\n255\n" + bytes([0, 0])


def _sets(spark):
    random = np.random.default_rng(5)
    x = random.normal(0, 1, (120, 2))
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] > v[1])) for i, v in enumerate(x)], "key int, x array<double>, y double")
    return dataset.datasets(rows, 100, 5, 10, "key")


def test_a_run_goes_on_where_it_was(spark, tmp_path):
    train, test = _sets(spark)
    options = experiment.Options(steps=4, workers=5, declared=1, real=1, rule="median", attack="empire", attack_options={"factor": 1.5}, rate=1.0, evaluate_every=2, test_repeat=2, batch=5, privacy=True, l2=0.01)
    whole = experiment.run(train, test, 2, options)
    assert [s for s, _ in whole.evaluation] == [0, 2, 4] and [r[0] for r in whole.study] == [0, 1, 2, 3]
    folder = f"file://{tmp_path}/run"
    part = experiment.run(train, test, 2, options, folder, stop=lambda step: step == 3)
    assert len(part.study) == 3
    rest = experiment.run(train, test, 2, options, folder)
    assert rest.params == pytest.approx(whole.params) and [r[0] for r in rest.study] == [3]
    session = runs.Session(spark, folder)
    found = session.compute_all().data.orderBy("step").collect()
    assert [r.step for r in found] == [0, 1, 2, 3, 4] and [r.defense_norm for r in found[:4]] == pytest.approx([r[8] for r in whole.study])
    assert [r.accuracy for r in found] == [whole.evaluation[0][1], None, whole.evaluation[1][1], None, whole.evaluation[2][1]]
    assert session.has_known_ratio() and session.get("ACC").columns == ["accuracy"] and found[0].lr == 1.0
    assert experiment.Options(**session.config) == options
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert runs.Session(spark, f"file://{tmp_path}/none").data is None and len(said) == 3


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", [1, 3, 4])
def test_a_run_may_die_between_any_two_writes(spark, tmp_path, monkeypatch, at):
    """The at-th write, from the settings on, is the last one that is begun; then the run goes on, and every row is there once."""
    train, test = _sets(spark)
    options = experiment.Options(steps=2, workers=3, declared=0, rule="average", rate=1.0, evaluate_every=1, test_repeat=1, batch=5)
    left = [at]

    def dying(of):
        def write(*args, **named):
            left[0] -= 1
            if left[0] == -1:
                if at % 2:
                    of(*args, **named)  # killed behind a write, or before it
                raise Killed
            return of(*args, **named)

        return write

    folder = f"file://{tmp_path}/run"
    with monkeypatch.context() as m:
        for owner, name in ((experiment.runs, "write"), (experiment.runs, "write_json"), (experiment.Checkpoint, "save"), (experiment.Commits, "commit"), (experiment.Commits, "forget")):
            m.setattr(owner, name, dying(getattr(owner, name)))
        with pytest.raises(Killed):
            experiment.run(train, test, 2, options, folder)
    done = experiment.run(train, test, 2, options, folder)
    found = runs.Session(spark, folder).data.orderBy("step").collect()
    assert [(r.step, r.datapoints is None, r.accuracy is None) for r in found] == [(0, False, False), (1, False, False), (2, True, False)]
    again = experiment.run(train, test, 2, options, folder)
    assert not again.study and not again.evaluation and again.params == pytest.approx(done.params)
    assert runs.Session(spark, folder).data.count() == 3
    more = experiment.run(train, test, 2, dataclasses.replace(options, steps=3), folder) if at == 4 else None
    assert more is None or [r[0] for r in more.study] == [2]
    with pytest.raises(RuleError, match="rate"):
        experiment.run(train, test, 2, dataclasses.replace(options, rate=2.0), folder)


def test_commits(spark, tmp_path):
    kept = commits.Commits(spark, f"file://{tmp_path}/log")
    assert kept.numbers() == [] and kept.last() is None and kept.paths("a") == []
    for k in range(3):
        runs.write(spark.createDataFrame([(k, 0.5)], runs.EVAL), f"{kept.folder}/{(part := kept.place('a'))}")
        assert kept.commit({"a": part, "n": k}) == k
    runs.write(spark.createDataFrame([(9, 0.5)], runs.EVAL), f"{kept.folder}/{kept.place('a')}")  # never committed
    (tmp_path / "log" / "commits" / ".half").write_text("{")
    assert sorted(r.step for r in runs.read(spark, kept.paths("a"), runs.EVAL).collect()) == [0, 1, 2] and kept.last()["n"] == 2
    kept.forget("a", 1)
    assert [runs.exists(spark, p) for p in kept.paths("a")] == [False, False, True]


def test_a_grid_reports_what_fails(spark, tmp_path):
    train, test = _sets(spark)
    base = experiment.Options(steps=1, workers=3, declared=0, batch=5, test_repeat=1, evaluate_every=1)
    settings = [{"rule": "average"}, {"rule": "krum"}]
    done = experiment.grid(lambda o: train, lambda o: test, 2, base, settings, f"file://{tmp_path}", (1, 2), together=2)
    assert [(n, s) for n, s, _ in done] == [("rule_average", 1), ("rule_average", 2), ("rule_krum", 1), ("rule_krum", 2)]
    assert [x == "done" for *_, x in done] == [True, True, False, False] and "RuleError" in done[2][2]
    found = experiment.averaged(spark, f"file://{tmp_path}", settings[:1], (1, 2), "accuracy").orderBy("step").collect()
    assert [(r.step, r.seeds) for r in found] == [(0, 2), (1, 2)]
    with pytest.raises(RuleError):
        experiment.checked(experiment.Options(real=5))


def test_command_line():
    paths, options = options_of("--train a --test b --results c --steps 7 --rule krum --rule-options m:2 --attack empire --attack-options factor:1.5 negative:true --privacy --clip none --rate 0.5".split())
    assert (paths.train, paths.results, options.steps, options.rule_options, options.attack_options) == ("a", "c", 7, {"m": 2}, {"factor": 1.5, "negative": True})
    assert options.privacy and options.clip is None and options.rate == 0.5 and options.workers == 11
    for wrong in ("--rule none", "--steps x", "--real 9"):
        with pytest.raises((RuleError, SystemExit)):
            options_of(["--train", "a", "--test", "b", "--results", "c", *wrong.split()])
