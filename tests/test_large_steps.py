"""What lets steps be large: subsets by rank, minimum diameters without them, medians by bits, distances by parts."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadfold.functions import bounds
from steadfold.functions.combinations import choose
from steadfold.operators import kernels, prefix, rules, search, selection

SCHEMA = "step int, worker int, g array<double>"


def test_binomials(spark):
    cases = [(n, k) for n in (0, 1, 5, 34, 50) for k in range(-1, min(n, 6) + 2)] + [(50, 25), (61, 58)]
    got = spark.createDataFrame(cases, "n int, k int").select("n", "k", choose(F.col("n"), F.col("k")).alias("c")).collect()
    import math

    assert all(r.c == (math.comb(r.n, r.k) if 0 <= r.k <= r.n else 0) for r in got)


def test_subsets_by_rank(spark):
    rows = rules.subsets(spark.createDataFrame([(3, "a"), (7, "b"), (1, "c")], "n int, of string"), 2)
    got = {(r.n, r.i): r["at"] for r in rows.collect()}
    assert [got[7, i] for i in range(21)] == [list(c) for c in itertools.combinations(range(7), 5)]
    assert [got[3, i] for i in range(3)] == [[0], [1], [2]] and len(got) == 24
    many = rules.subsets(spark.createDataFrame([(34,)], "n int"), 2)
    assert many.agg(F.count("*"), F.count_distinct("at"), F.max("i")).first()[:] == (561, 561, 560)


def test_copies_in_pieces(spark):
    rows = spark.createDataFrame([("a", 7), ("b", 0), ("c", None), ("a", 7)], "k string, n long")
    got = sorted((r.k, r.i) for r in prefix.multiplied(rows, F.col("n"), "i", piece=3).collect())
    assert got == sorted(("a", i) for i in range(7) for _ in range(2))


def odd_steps(sizes, seed):
    """Steps with ties, equal vectors, and some with vectors that aren't finite."""
    rng, rows = random.Random(seed), []
    for step, n in enumerate(sizes):
        for w in range(n):
            g = [float(rng.randint(0, 3)) if step % 3 else rng.random() for _ in range(3)]
            rows.append((step, w * 3, [float("nan"), 1.0, 2.0] if step % 5 == 4 and w < 2 else [float("inf"), 0.0, 1.0] if step % 7 == 6 and w == 1 else g))
    return rows


@pytest.mark.parametrize("f", [0, 1, 2, 3])
def test_minimum_diameter_against_all_subsets(spark, f):
    rows = odd_steps([7, 8, 9, 7, 11, 12, 7, 8], f)
    frame = spark.createDataFrame(rows, SCHEMA)
    best = {}
    for r in rules.subset_diameters(frame, f).collect():
        if r.diameter < float("inf"):
            now = (round(r.diameter, 9), r.workers)
            best[r.step] = min(best.get(r.step, now), now)
    got = {r.step: (round(r.diameter, 9), r.workers) for r in rules.brute_selection(frame, f).collect()}
    assert got == best and got
    assert {r.step: (round(r.diameter, 9), r.workers) for r in rules.brute_selection(frame, f, blocks=2, parts=2).collect()} == best
    for step, (_, workers) in best.items():
        g = np.array([x for s, _, x in rows if s == step])
        assert np.allclose(kernels.brute(g, f), g[[w // 3 for w in workers]].mean(axis=0))


def test_minimum_diameter_of_two_hundred_workers(spark):
    rng = np.random.default_rng(5)
    g = np.concatenate([rng.normal(0, 1, (197, 4)), rng.normal(30, 1, (3, 4))])
    order = rng.permutation(200)
    frame = spark.createDataFrame([(0, int(w), g[i].tolist()) for w, i in enumerate(order)], SCHEMA)
    since, found = time.time(), rules.brute_selection(frame, 3).first()
    assert set(range(200)) - set(found.workers) == {w for w, i in enumerate(order) if i >= 197}
    assert time.time() - since < 60
    assert rules.brute_selection(frame.limit(34), 2).first().diameter <= found.diameter


def test_medians_by_bits(spark):
    special = [1.0, 5.0, -2.0, 0.0, -0.0, 1e308, -1e308, float("inf"), -float("inf"), 5e-324, -5e-324, 7.0, 7.0]
    rows = [(0, w, [v, v if abs(v) < 2 else float("nan"), special[-1 - w]]) for w, v in enumerate(special)] + [(1, 0, [3.0, float("nan"), 0.5]), (1, 1, [2.0, 1.0, 0.5])]
    frame = spark.createDataFrame(rows, SCHEMA)
    for variant in ("lower", "finite"):
        expected = {(r.step, r.pos): repr(r.val + 0.0) for r in rules.median(frame, variant).collect()}
        assert {(r.step, r.pos): repr(r.val) for r in rules.median(frame, variant, by_bits=True).collect()} == expected
    assert rules.median(frame.limit(0), by_bits=True).count() == 0


def test_ranks(spark):
    rng = random.Random(2)
    values = [(k, rng.choice([None, 0.1, -3.0, rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300)])) for k in (1, 2, 2, 2, None, 4) * 20] + [(9, None)]
    frame = spark.createDataFrame(values, "k int, v double")
    for share in (0.0, 0.3, 1.0):
        got = {r.k: (r.v, r.n) for r in selection.nth(frame, "v", F.floor((F.col("n") - 1) * share), "k").collect()}
        for k in (1, 2, None, 4, 9):
            own = sorted(v for x, v in values if x == k and v is not None)
            assert got[k] == (own[int((len(own) - 1) * share)] if own else None, len(own))


def test_distances_by_parts(spark):
    frame = spark.createDataFrame(odd_steps([6, 5, 7, 4, 6], 3), SCHEMA)
    plain = {(r.step, r.x, r.y): r.d for r in rules.pairs(frame).collect()}
    for blocks, parts in ((3, 2), (1, 7), (2, 3)):
        got = {(r.step, r.x, r.y): r.d for r in rules.pairs(frame, blocks=blocks, parts=parts).collect()}
        assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k], abs=1e-12) for k in plain)


def test_two_thousand_workers_run_in_many_tasks(spark):
    frame = spark.range(2000).select(F.lit(0).alias("step"), F.col("id").cast("int").alias("worker"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.sin(F.col("id") * 7 + k)).alias("g"))
    spread = rules.pairs(frame, blocks=8, parts=2)
    joined = spread.groupBy("x").count()
    assert joined.count() == 1999 and spread.count() == 1999 * 1000


def test_rules_of_ones_own_have_checks_bounds_and_influence(spark):
    frame = spark.createDataFrame([(0, w, [float(w), 1.0]) for w in range(5)], SCHEMA).withColumn("is_byz", F.col("worker") > 3)
    first = lambda rows, f: rows.where(F.col("worker") < f).select("step", "worker")
    rule = lambda rows, f: rules.average(rows.join(first(rows, f), ["step", "worker"], "left_semi"))
    rules.register("first", rule, check=lambda n, f, m: None if f <= n else "f is too large", bound=lambda n, f: f / n, selection=first)
    try:
        assert [r.val for r in rules.aggregate(frame, "first", 2).orderBy("pos").collect()] == [0.5, 1.0]
        with pytest.raises(bounds.RuleError, match="too large"):
            rules.aggregate(frame, "first", 9)
        assert rules.influence_of(frame, "first", 5).first().influence == 0.2
        assert spark.range(1).select(bounds.bound("first", F.lit(4), F.lit(1)).alias("b")).first().b == 0.25
        with pytest.raises(bounds.RuleError):
            rules.register("first", rule)
    finally:
        rules.unregister("first")
    assert rules.influence_of(frame, "average", 0).first().influence == 0.2
    for call in (lambda: rules.influence_of(frame, "median", 1), lambda: bounds.check("first", 5, 1), lambda: bounds.bound("average", F.lit(1), F.lit(1)), lambda: rules.unregister("krum")):
        with pytest.raises(bounds.RuleError):
            call()


def test_search_in_rows(spark):
    tops = [0.0, 0.3, 1.7, 12.5, 999.0]
    rows = search.maxima(spark.createDataFrame([(t,) for t in tops], "at double"), lambda x: -(x - F.col("at")) * (x - F.col("at")), 20)
    assert {r["at"]: r.best for r in rows.collect()} == pytest.approx({t: search.maximum(lambda x, t=t: -((x - t) ** 2), 20) for t in tops})
    with pytest.raises(ValueError, match="top"):
        search.maxima(rows.withColumn("top", F.lit(1)).drop("best"), lambda x: x)


def folded_distances(g, take, squared=False):
    with np.errstate(all="ignore"):
        d = np.stack([((g - x) ** 2).sum(axis=1) for x in g])
    d = np.where(np.isfinite(d), d if squared else np.sqrt(d), np.inf)
    return [np.sort(np.delete(row, i))[:take].sum() for i, row in enumerate(d)]


@pytest.mark.parametrize(("take", "squared"), [(-51, False), (7, True), (0, False)])
def test_scores_of_large_steps(spark, take, squared):
    rng, want, rows = np.random.default_rng(9), {}, []
    for step, n in enumerate((700, 300, 40, 1)):
        g = rng.normal(step * 1e6, 1, (n, 5))
        if n > 100:
            g[3], g[4], g[5], g[6:20] = np.nan, 1e200, np.inf, g[20]
        rows += [(step, w * 2, None if step == 0 and w == 3 else x.tolist()) for w, x in enumerate(g)]
        count = take + n if take < 0 else take or n - 1
        want |= {(step, w * 2): s for w, s in enumerate(folded_distances(g, count, squared) if 0 < count and n > 1 else ())}
    frame = spark.createDataFrame(rows, SCHEMA)
    count = (lambda n: n + take) if take < 0 else lambda n: F.lit(take) if take else n - 1
    for blocks, parts in ((3, 2), (1, 5)):
        found = rules.neighbour_scores(frame, count, squared, blocks, parts).collect()
        assert {(r.step, r.worker): r.score for r in found} == pytest.approx(want, rel=1e-12) and len(found) == len(want)
        for step in {s for s, _ in want}:
            order = sorted((round(r.score, 9), r.worker, r["rank"]) for r in found if r.step == step)
            assert [x[2] for x in order] == list(range(1, len(order) + 1))


def test_scores_of_one_large_step_in_time(spark):
    frame = spark.range(8000).select(F.lit(0).alias("step"), F.col("id").cast("int").alias("worker"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.sin(F.col("id") * 7 + k * k)).alias("g"))
    since = time.time()
    assert rules.krum_selection(frame, 50, blocks=4, parts=4).count() == 8000 - 52
    assert time.time() - since < 60


@pytest.mark.parametrize("f", [1, 2])
def test_minimum_diameter_of_large_steps(spark, f):
    rng, rows, vectors = np.random.default_rng(f), [], {}
    for step, n in enumerate((3000, 3000, 50)):
        g = rng.normal(0, 1, (n, 4)) if step else rng.integers(0, 40, (n, 4)).astype(float)
        g[7], g[n - 3] = (np.nan, g[9]) if step == 1 else (g[8] * 9, g[9] - 60)
        vectors[step] = g
        rows += [(step, w, x.tolist()) for w, x in enumerate(g)]
    since = time.time()
    found = rules.brute_selection(spark.createDataFrame(rows, SCHEMA), f, blocks=2, parts=2).collect()
    assert time.time() - since < 60
    assert len(found) == 3
    for r in found:
        g = vectors[r.step]
        assert len(r.workers) == len(g) - f and np.allclose(kernels.brute(g, f), g[r.workers].mean(axis=0), rtol=1e-12)
        assert r.diameter == pytest.approx(max(np.sqrt(((g[r.workers] - x) ** 2).sum(axis=1)).max() for x in g[r.workers]), rel=1e-12)
