"""Rules on small lists: worked examples, independent list implementations, bounds, and what robustness promises."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steadfold.functions import bounds
from steadfold.operators import attacks, kernels, metrics, prefix, rules, search, training

NAN = float("nan")


def frame(spark, vectors, step=0, byz=()):
    rows = [(step, i, [float(x) for x in v], i in byz) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "step long, worker int, g array<double>, is_byz boolean")


def values(result):
    return [r.val for r in result.orderBy("step", "pos").collect()]


BASE = np.array([1.0, 2.0, 3.0])


def around(*offsets):
    return [BASE + o for o in offsets]


@pytest.mark.parametrize(
    ("rule", "vectors", "f", "options", "expected"),
    [
        ("average", [(1, 2, 3), (4, 5, 6)], 0, {}, (2.5, 3.5, 4.5)),
        ("median", [(1, 100, 3), (2, 200, 4), (3, 300, 5)], 0, {}, (2, 200, 4)),
        ("krum", [*around(0, 0.1, -0.1, 0.2), (100, 200, 300)], 1, {"m": 2}, (1.05, 2.05, 3.05)),
        ("bulyan", [*around(0, 0.1, -0.1, 0.2, -0.2, 0.05), (100, 200, 300)], 1, {}, (1, 2, 3)),
        ("brute", [*around(0, 0.1, -0.1), (100, 200, 300), (-100, -200, -300)], 2, {}, (1, 2, 3)),
    ],
)
def test_worked_examples(spark, rule, vectors, f, options, expected):
    assert values(rules.aggregate(frame(spark, vectors), rule, f, **options)) == pytest.approx(expected)


def test_medians(spark):
    even = frame(spark, [(1,), (2,), (3,), (4,)])
    assert values(rules.median(even)) == [2]
    assert values(rules.median(even, "finite")) == [3]
    holed = frame(spark, [(1, NAN), (NAN, NAN), (3, NAN), (4, NAN), (5, NAN)])
    found = values(rules.median(holed))
    assert math.isnan(found[0]) and math.isnan(found[1])
    assert values(rules.median(holed, "finite")) == [4, 0]


@pytest.mark.parametrize(("rule", "n", "f", "m"), [("krum", 4, 1, None), ("krum", 5, 1, 3), ("krum", 5, 1, 0), ("krum", 5, 0, None), ("bulyan", 6, 1, None), ("bulyan", 7, 1, 5), ("brute", 2, 1, None), ("average", 0, 0, None), ("krum", 5, True, None)])
def test_bounds_refuse(rule, n, f, m):
    with pytest.raises(bounds.RuleError):
        bounds.check(rule, n, f, m)


@pytest.mark.parametrize(("rule", "n", "f", "m"), [("krum", 5, 1, 2), ("bulyan", 7, 1, 4), ("brute", 3, 1, None), ("average", 1, 0, None), ("median", 1, 0, None)])
def test_bounds_allow(rule, n, f, m):
    bounds.check(rule, n, f, m)


def test_a_step_too_small_is_refused(spark):
    with pytest.raises(bounds.RuleError):
        rules.aggregate(frame(spark, around(0, 1, 2, 3)), "krum", 1)
    with pytest.raises(bounds.RuleError):
        rules.aggregate(frame(spark, around(0, 1, 2, 3)), "unknown", 1)
    with pytest.raises(bounds.RuleError):
        rules.register("krum", rules.krum)


def list_krum_order(vectors, k):
    scores = []
    for i, x in enumerate(vectors):
        d = sorted(float(np.linalg.norm(x - y)) if np.isfinite(x - y).all() else math.inf for j, y in enumerate(vectors) if j != i)
        scores.append((round(sum(d[:k]), 9), i))
    return [i for _, i in sorted(scores)]


def list_bulyan(vectors, f):
    n = len(vectors)
    m, order = n - f - 2, list_krum_order(vectors, n - f - 2)
    means = [np.mean([vectors[w] for w in order[i : i + min(m, n - f - 2 - i)]], axis=0) for i in range(n - 2 * f - 2)]
    out = []
    for column in np.array(means).T:
        mid = sorted(column)[(len(column) - 1) // 2]
        near = sorted(range(len(column)), key=lambda i: (round(abs(column[i] - mid), 9), i))[: len(column) - 2 * f]
        out.append(np.mean([column[i] for i in near]))
    return out


def list_brute(vectors, f):
    n = len(vectors)
    diameter = lambda s: max((float(np.linalg.norm(vectors[a] - vectors[b])) for a, b in itertools.combinations(s, 2)), default=0)
    best = min(itertools.combinations(range(n), n - f), key=lambda s: (round(diameter(s), 9), s))
    return np.mean([vectors[i] for i in best], axis=0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_against_lists(spark, seed):
    random = np.random.default_rng(seed)
    vectors = list(random.normal(0, 1, (9, 3)).round(3))
    rows = frame(spark, vectors)
    picked = list_krum_order(vectors, 9 - 2 - 1)[: 9 - 2 - 2]
    assert values(rules.krum(rows, 2)) == pytest.approx(np.mean([vectors[i] for i in picked], axis=0))
    assert values(rules.bulyan(rows, 1)) == pytest.approx(list_bulyan(vectors, 1))
    assert values(rules.brute(rows, 2)) == pytest.approx(list_brute(vectors, 2))
    moved = frame(spark, [v * 3 + 1 for v in vectors])
    assert values(rules.krum(moved, 2)) == pytest.approx([3 * x + 1 for x in values(rules.krum(rows, 2))])


def test_vectors_of_nan_are_not_selected(spark):
    vectors = [*around(0, 0.1, -0.1, 0.2, 0.3, -0.2, 0.05), [NAN] * 3]
    for rule in ("krum", "bulyan", "brute"):
        found = values(rules.aggregate(frame(spark, vectors), rule, 1))
        assert all(0 < x < 4 for x in found), rule


def test_ties_go_to_the_smaller_worker(spark):
    rows = frame(spark, [(0.0,)] * 7)
    assert [r.worker for r in rules.krum_selection(rows, 2, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert rules.brute_selection(rows, 2).first().workers == [0, 1, 2, 3, 4]


def test_kernel_is_the_same(spark):
    vectors = list(np.random.default_rng(1).normal(0, 1, (12, 5))) + [[NAN] * 5]
    a = {(r.x, r.y): r.d for r in rules.pairs(frame(spark, vectors)).collect()}
    b = {(r.x, r.y): r.d for r in rules.pairs_by_kernel(frame(spark, vectors)).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    for found in (rules.pairs(frame(spark, vectors), blocks=3), rules.pairs_by_kernel(frame(spark, vectors), 4)):
        rows = found.collect()
        assert len(rows) == len(a) and all(a[r.x, r.y] == pytest.approx(r.d) for r in rows)


def list_pruned(vectors, f):
    n, left, out = len(vectors), list(range(len(vectors))), []
    near = {i: dict(sorted(((j, float(((vectors[i] - vectors[j]) ** 2).sum())) for j in range(n) if j != i), key=lambda x: (x[1], x[0]))[: n - f - 2]) for i in range(n)}
    for k in range(n - 2 * f - 2):
        score = {i: round(sum(d for j, d in near[i].items() if j in left), 9) for i in left}
        order = sorted(left, key=lambda i: (score[i], i))
        out.append(np.mean([vectors[i] for i in order[: max(1, min(n - f - 2 - k, len(order)))]], axis=0))
        left.remove(order[0])
    found = []
    for column in np.array(out).T:
        mid = sorted(column)[len(column) // 2]
        found.append(np.mean(sorted(column, key=lambda v: round(abs(v - mid), 9))[: len(column) - 2 * f]))
    return found


def test_pruned_bulyan_against_lists(spark):
    for seed, f, n in ((1, 1, 9), (2, 2, 12)):
        vectors = list(np.random.default_rng(seed).normal(0, 1, (n, 4)).round(3))
        assert values(rules.bulyan_pruned(frame(spark, vectors), f)) == pytest.approx(list_pruned(vectors, f))


def test_attacks(spark):
    rows = frame(spark, [(1, 2, 3), (4, 5, 6), (0, 0, 0)], byz={2})
    honest = rows.where("NOT is_byz")
    made = {r.worker: r.g for r in attacks.identical(honest, "little", 2, 1.5).collect()}
    assert made.keys() == {2, 3} and made[2] == pytest.approx([2.5 + 1.5 * 3 / math.sqrt(2), 3.5 + 1.5 * 3 / math.sqrt(2), 4.5 + 1.5 * 3 / math.sqrt(2)])
    assert attacks.identical(honest, "empire", 1, 2.0).first().g == pytest.approx([-2.5, -3.5, -4.5])
    assert attacks.identical(honest, "bulyan", 1, 2.0).first().g == pytest.approx([2.5, 3.5, 6.5])
    assert attacks.identical(honest, "bulyan", 1, 2.0, target="all", negative=True).first().g == pytest.approx([0.5, 1.5, 2.5])
    assert attacks.identical(honest, "empire", 0).count() == 0
    assert all(math.isnan(x) for x in attacks.nan(honest, 1).first().g)
    with pytest.raises(bounds.RuleError):
        attacks.identical(honest, "empire", -1)


@pytest.mark.parametrize("top", [0.0, 0.3, 1.0, 7.5, 100.0])
def test_search_finds_a_top(top):
    assert search.maximum(lambda x: -((x - top) ** 2), 60) == pytest.approx(top, abs=0.05 * max(1, top))


def test_search_places():
    """The trials on a parabola with its top at 2.2, by hand; and on a falling line, where no trial leaves it."""
    asked = []
    assert search.maximum(lambda x: asked.append(x) or -((x - 2.2) ** 2), 8) == pytest.approx(1.6496)
    assert asked == pytest.approx([0, 1, 3, 7, 3.8, 1.24, 3.288, 1.6496])
    falling = []
    assert search.maximum(lambda x: falling.append(x) or -x, 8) == 0
    assert falling[:2] == [0, 1] and min(falling) >= 0


@pytest.mark.parametrize("defence", list(kernels.KERNELS))
def test_kernels_are_the_rules(spark, defence):
    random = np.random.default_rng(11)
    vectors = np.concatenate([random.normal(0, 1, (8, 4)).round(2), [[math.nan] * 4]] if defence in ("krum", "bulyan", "brute") else [random.normal(0, 1, (9, 4)).round(2)])
    expected = values(rules.aggregate(frame(spark, vectors), defence, 1 if defence != "average" else 0))
    assert kernels.KERNELS[defence](vectors, 1) == pytest.approx(expected)


@pytest.mark.parametrize("defence", list(kernels.KERNELS))
def test_searched_factors(spark, defence):
    """The search by groups, by rounds, and by a plain loop over the rule itself; the vectors are built with what it found."""
    honest = frame(spark, list(np.random.default_rng(2).normal(1, 0.1, (7, 3))))
    options = {"f_decl": 2, "f_real": 2, "defence": defence, "evals": 5}
    if defence == "bulyan":
        options |= {"f_decl": 1}
    a = attacks.auto(honest, "little", **options).first()
    b = attacks.auto_in_rounds(honest, "little", **options).first()
    assert (a.factor, a.gain) == pytest.approx((b.factor, b.gain)) and a.gain >= 0
    made = attacks.identical(honest, "little", 2, -5, f_decl=options["f_decl"], defence=defence).collect()
    plain = attacks.identical(honest, "little", 2, a.factor).collect() if a.factor else None
    assert len(made) == 2 and (plain is None or made[0].g == pytest.approx(plain[0].g))


def test_search_to_the_other_side(spark):
    honest = frame(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)])
    away, compat = (attacks.identical(honest, "empire", 1, -4, negative=True, defence="average", compat=c).first().g for c in (False, True))
    factor = attacks.auto(honest, "empire", 1, 1, "average", 4, True).first().factor
    mean = np.array([2.0, 12.5 / 3])
    assert factor == -7 and away == pytest.approx(8 * mean) and compat == pytest.approx(-6 * mean)
    with pytest.raises(bounds.RuleError):
        attacks.identical(honest, "empire", 1)


def test_attacks_of_ones_own(spark):
    attacks.register("zeros", lambda honest, f_real: attacks._repeated(honest.groupBy("step").agg(F.count("*").alias("n")).withColumn("g", F.array(F.lit(0.0), F.lit(0.0))), f_real))
    try:
        rows = frame(spark, [(1, 2), (3, 4), (5, 6)], byz={2})
        assert [r.g for r in attacks.with_attack(rows, "zeros", 2, checked=True).where("is_byz").collect()] == [[0, 0]] * 2
        with pytest.raises(bounds.RuleError):
            attacks.register("zeros", attacks.nan)
        with pytest.raises(bounds.RuleError):
            attacks.with_attack(rows, "none", 1)
        attacks.ATTACKS["zeros"] = lambda honest, f_real: attacks.nan(honest, f_real + 1)
        with pytest.raises(bounds.RuleError):
            attacks.with_attack(rows, "zeros", 2, checked=True)
    finally:
        del attacks.ATTACKS["zeros"]


def test_statistics(spark):
    one = metrics.avg_dev_max(frame(spark, [(3, -4)]), "step").first()
    assert (one.norm, one.dev, one.max) == (5, 0, 4)
    two = metrics.avg_dev_max(frame(spark, [(3, 4), (0, 1)]), "step").first()
    assert two.norm == 3 and two.dev == pytest.approx(math.sqrt(8))
    rows = frame(spark, [(1, 0), (1, 0)])
    study = metrics.study(rows, rules.average(rows)).first()
    assert study.cos_hon_def == pytest.approx(1) and math.isnan(study.cos_hon_att) and math.isnan(study.attack_norm)


def test_training_steps(spark):
    assert training.split_point(10, 0.01) == 1 and training.split_point(10, 0.99) == 9 and training.split_point(10, 20) == 9
    with pytest.raises(bounds.RuleError):
        training.privacy_sigma(1, 1, 1.5, 0.5)
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 AS key", "id")
    found = prefix.numbered(rows, "key", "id").orderBy("rn").collect()
    assert [r.rn for r in found] == list(range(1000)) and [r.key for r in found] == sorted(r.key for r in found)
    clash = spark.createDataFrame([(3, "a", 1), (1, "b", 2), (None, "c", 3)], "part long, at string, base int")
    assert [tuple(r) for r in prefix.numbered(clash, "part").orderBy("rn").collect()] == [(None, "c", 3, 0), (1, "b", 2, 1), (3, "a", 1, 2)]
    assert prefix.numbered(clash.limit(0), "part").count() == 0
    sums = prefix.running(rows.selectExpr("key", "id"), {"a": "id", "b": "key"}, "key", "id").orderBy("key", "id").collect()
    assert [(r.a, r.b) for r in sums] == [(sum(x.id for x in sums[:k]), sum(x.key for x in sums[:k])) for k in range(1000)]
    noisy = training.with_noise(frame(spark, [[0.0] * 400] * 5), 2.0, 3)
    drawn = np.array([x for r in noisy.collect() for x in r.g])
    assert abs(drawn.mean()) < 0.2 and drawn.std() == pytest.approx(2, abs=0.15)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_wide_rows_keep_their_places(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(100_000).selectExpr("id", "repeat(sha2(string(id), 256), 32) AS wide")
        found = prefix.numbered(rows, F.xxhash64("id")).agg(F.count("*"), F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.min(F.length("wide"))).first()
        assert tuple(found) == (100_000, 100_000, 0, 99_999, 2048)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_within_groups(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, null, id % 3) AS a", "cast(id < 900 AS string) AS b", "id AS n")
    found = prefix.within(rows, "n", "a", "b").groupBy("a", "b").agg(F.count("*").alias("k"), F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert sorted((r.k, r.d, r.lo, r.hi) for r in found) == [(33, 33, 0, 32), (33, 33, 0, 32), (34, 34, 0, 33), (900, 900, 0, 899)]
    assert prefix.within(rows.limit(0), "k", "a").count() == 0


def test_training_learns_in_spite_of_attackers(spark):
    random = np.random.default_rng(4)
    x = random.normal(0, 1, (1100, 2))
    rows = [(i % 5, i % 11, v.tolist(), float(v[0] - v[1] > 0)) for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "step long, worker int, x array<double>, y double")

    def attack(grads):
        byz = grads.selectExpr("*", "worker >= 8 AS is_byz")
        return attacks.with_attack(byz, "empire", 3, factor=3.0)

    params, log = training.train(samples, 2, 5, "krum", 3, rate=5.0, attack=attack)
    assert params[0] > 0.3 and params[1] < -0.3 and len(log) == 5
    weights = training.regression(samples, 2)
    design = np.c_[x, np.ones(len(x))]
    assert weights == pytest.approx(np.linalg.lstsq(design, [r[3] for r in rows], rcond=None)[0], abs=1e-2)
