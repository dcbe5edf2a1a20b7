"""Robust aggregation rules over vectors grouped by step.

Input: step, worker, g (array of doubles), one row for each worker of a step.
Of two workers that tie, the smaller number comes first.  Rules return the
aggregate in long form, (step, pos, val), and selections as (step, worker, ...).

Distances need the pairs of a step, so their cost grows with the square of its
workers, but steps are independent: everything is keyed by step, and no plan
has a join without that key.  Averages and medians are keyed by (step, pos) and
spread a large step over as many tasks as it has coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadfold.functions import bounds
from steadfold.functions.combinations import choose, members
from steadfold.functions.vectors import INF, NAN, finite_or_inf, squared_distance, total
from steadfold.operators import prefix, selection

#: Digits that scores and diameters are ranked by: sums of the same numbers in another order must tie.
DIGITS = 9
#: Steps of over MANY workers have their distances folded where they are computed, in blocks of about BLOCK workers.
MANY, BLOCK = 256, 2048
#: Squared distances below this share of what they are the difference of are computed from the vectors' differences.
CANCELLED = 1e-2


def long_form(rows: DataFrame) -> DataFrame:
    """(step, worker, g) -> (step, worker, pos, val)."""
    return rows.select("step", "worker", F.posexplode("g").alias("pos", "val"))


def wide_form(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, val) -> (keys, g)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "val")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["val"]).alias("g"))


def verify(rows: DataFrame, rule: str, f: int, m: int | None = None) -> DataFrame:
    """``rows``, after a check of the smallest and the largest step against the rule's parameters."""
    sizes = rows.groupBy("step").count().agg(F.min("count"), F.max("count")).first()
    for n in sizes:
        bounds.check(rule, int(n or 0), f, m)
    return rows


def average(rows: DataFrame) -> DataFrame:
    """Coordinate-wise mean; NaN and infinities take part."""
    return long_form(rows).groupBy("step", "pos").agg(F.avg("val").alias("val"))


def lower_median(val: Column) -> Column:
    """The lower median, NaN if any value is."""
    return F.when(F.max(F.isnan(val)), F.lit(NAN)).otherwise(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {val._jc.toString()})"))


def median(rows: DataFrame, variant: str = "lower", by_bits: bool = False) -> DataFrame:
    """Coordinate-wise median.  ``lower``: the lower one, NaN if any value is.  ``finite``: the upper one of finite values, 0 if there is none.

    With ``by_bits`` no task holds a coordinate's values: they are narrowed down
    in rounds of counts, for steps of very many workers.
    """
    if by_bits:
        return _median_by_bits(rows, variant)
    coords = long_form(rows).groupBy("step", "pos")
    if variant == "lower":
        return coords.agg(lower_median(F.col("val")).alias("val"))
    values = F.sort_array(F.collect_list(F.when(~F.isnan("val") & (F.abs("val") < INF), F.col("val"))))
    return coords.agg(values.alias("v")).select("step", "pos", F.coalesce(F.get("v", (F.size("v") / 2).cast("int")), F.lit(0.0)).alias("val"))


def _median_by_bits(rows: DataFrame, variant: str) -> DataFrame:
    finite = ~F.isnan("val") & (F.abs("val") < INF)
    used = F.when(finite, F.col("val")) if variant == "finite" else F.col("val")
    rank = F.floor(F.col("n") / 2) if variant == "finite" else F.floor((F.col("n") - 1) / 2)
    found = selection.nth(long_form(rows).withColumn("val", used), "val", rank, "step", "pos")
    val = F.coalesce("val", F.lit(0.0)) if variant == "finite" else F.when(F.col("any_nan"), F.lit(NAN)).otherwise(F.col("val"))
    return found.select("step", "pos", val.alias("val"))


def pairs(rows: DataFrame, squared: bool = False, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, x, y, d) for x < y: the distance, infinity where it isn't finite.

    Without ``blocks`` a step is one key of the join.  With them its workers
    are dealt into so many blocks by a hash, each pair of blocks is a key, and
    each vector is copied as often as there are blocks: for steps of very many
    workers.  With ``parts`` vectors are cut into so many parts, which are keys
    as well; a pair's sums of squares by part are added in their order: for very
    long vectors.
    """
    a = rows.select("step", F.col("worker").alias("x"), F.col("g").alias("gx"))
    b = rows.select("step", F.col("worker").alias("y"), F.col("g").alias("gy"))
    keys = ["step"]
    if parts > 1:
        keys.append("part")
        cut = lambda g: F.posexplode(F.transform(F.expr(f"sequence(0, {parts - 1})"), lambda k: F.slice(g, (k * F.ceil(F.size(g) / parts) + 1).cast("int"), F.ceil(F.size(g) / parts).cast("int"))))
        a, b = a.select("step", "x", cut("gx").alias("part", "gx")), b.select("step", "y", cut("gy").alias("part", "gy"))
    if blocks > 1:
        keys += ["bx", "by"]
        every = F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
        a = a.withColumn("bx", F.pmod(F.xxhash64("x"), F.lit(blocks))).withColumn("by", every)
        b = b.withColumn("by", F.pmod(F.xxhash64("y"), F.lit(blocks))).withColumn("bx", every)
    d, joined = squared_distance(F.col("gx"), F.col("gy")), a.join(b, keys).where("x < y")
    if parts > 1:
        sums = joined.select("step", "x", "y", F.struct("part", d.alias("s")).alias("s")).groupBy("step", "x", "y").agg(F.array_sort(F.collect_list("s")).alias("s"))
        d, joined = total(F.transform("s", lambda v: v["s"])), sums
    return joined.select("step", "x", "y", finite_or_inf(d if squared else F.sqrt(d)).alias("d"))


def pairs_by_kernel(rows: DataFrame, blocks: int = 1) -> DataFrame:
    """The same as ``pairs``, by differences of whole matrices: quicker for steps of hundreds of workers or more.

    A task has the vectors of one block of a step, or of two.
    """
    own = F.pmod(F.xxhash64("worker"), F.lit(blocks)).cast("int")
    dealt = rows.select("step", "worker", "g", own.alias("own")).withColumn("other", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    dealt = dealt.select("step", "worker", "g", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def distances(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("worker")
        g, block, workers = np.stack(part["g"].to_numpy()), part["own"].to_numpy(), part["worker"].to_numpy()
        i, j = np.triu_indices(len(g), 1)
        if part["i"].iloc[0] != part["j"].iloc[0]:  # pairs within a block have a task of their own
            apart = block[i] != block[j]
            i, j = i[apart], j[apart]
        with np.errstate(all="ignore"):
            d = np.concatenate([np.sqrt(((g[i[k : k + 4096]] - g[j[k : k + 4096]]) ** 2).sum(axis=1)) for k in range(0, len(i), 4096)] or [np.empty(0)])
        return pd.DataFrame({"step": part["step"].iloc[0], "x": workers[i], "y": workers[j], "d": np.where(np.isfinite(d), d, np.inf)})

    kinds = dict(rows.dtypes)
    return dealt.groupBy("step", "i", "j").applyInPandas(distances, f"step {kinds['step']}, x {kinds['worker']}, y {kinds['worker']}, d double")


def _wide(rows: DataFrame, blocks: int, parts: int) -> bool:
    """Whether a step that is to be spread has over MANY workers, which is one small job; a smaller one's pairs are few."""
    return (blocks > 1 or parts > 1) and (rows.groupBy("step").count().agg(F.max("count")).first()[0] or 0) > MANY


def _by_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(step, worker, g, n, own, i, j): each row for each pair of blocks i <= j that its own one is part of.

    There are ``blocks`` blocks, or more in steps of so many workers that each has about BLOCK.
    """
    rows = rows.select("step", "worker", "g").where("step IS NOT NULL AND worker IS NOT NULL")
    sized = rows.join(rows.groupBy("step").agg(F.count("*").alias("n")), "step")
    many = F.greatest(F.lit(blocks), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("worker"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return dealt.select("step", "worker", "g", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _spread(dealt: DataFrame, task: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A task for each pair of blocks; their number of partitions is fixed, as few bytes are much work here."""
    many = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(many, "step", "i", "j").groupBy("step", "i", "j").applyInPandas(task, schema)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, by a matrix product; by differences where little or nothing finite is left of it."""
    with np.errstate(all="ignore"):
        lengths = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        squares = lengths - 2 * (a @ b.T)
        again = ~(squares > CANCELLED * lengths)
        for k in np.flatnonzero(again.any(axis=1)):
            near = np.flatnonzero(again[k])
            squares[k, near] = ((b[near] - a[k]) ** 2).sum(axis=1)
    return squares


def _halves(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """A task's workers and vectors, of its one block and of its other, which is the same one if it has but one; a missing vector is NaN."""
    part = part.sort_values("worker")
    width = max(1, *(0 if g is None else len(g) for g in part["g"]))
    g = np.stack([np.full(width, NAN) if g is None else np.asarray(g, float) for g in part["g"]])
    first, workers, same = (part["own"] == part["i"]).to_numpy(), part["worker"].to_numpy(), bool(part["i"].iloc[0] == part["j"].iloc[0])
    return workers[first], g[first], workers[first if same else ~first], g[first if same else ~first], same


def _distances(a: np.ndarray, b: np.ndarray, squared: bool, parts: int) -> np.ndarray:
    """Of all rows of ``a`` to all of ``b``, infinity where they aren't finite; squares of parts are added in their order."""
    width = -(-a.shape[1] // parts)
    squares = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], width):
        squares += _squares(a[:, k : k + width], b[:, k : k + width])
    d = squares if squared else np.sqrt(squares)
    d[~np.isfinite(d)] = INF
    return d


def _scores_by_blocks(rows: DataFrame, count: Callable[[Column], Column], squared: bool, blocks: int, parts: int) -> DataFrame:
    """(step, worker, score, n): a task gives a sum of distances for each of its workers, and those that may be among the largest of all.

    What is left out of a sum is never part of it, so large distances take no
    digits from it.  If fewer are summed than left out, a task gives the
    smallest ones instead.
    """
    dealt = _by_blocks(rows, blocks).withColumn("take", F.least(count(F.col("n")), F.col("n") - 1).cast("long")).where("take > 0").withColumn("drop", F.col("n") - 1 - F.col("take"))

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        x, a, y, b, same = _halves(part)
        take, drop = int(part["take"].iloc[0]), int(part["drop"].iloc[0])
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        d, found = _distances(a, b, squared, parts), []
        if same:
            d = d[~np.eye(len(d), dtype=bool)].reshape(len(d), max(len(d) - 1, 0))
        for workers, own, block in ((x, d, j),) if same else ((x, d, j), (y, d.T, i)):
            n = own.shape[1]
            if not len(workers) or not n:
                continue
            cut = min(take, n) if take < drop else n - min(drop, n)
            own = np.partition(own, cut, axis=1) if 0 < cut < n else own
            rest, values = (np.zeros(len(own)), own[:, :cut]) if take < drop else (own[:, :cut].sum(axis=1), own[:, cut:])
            found.append(pd.DataFrame({"step": part["step"].iloc[0], "worker": workers, "block": block, "rest": rest, "values": list(values), "n": part["n"].iloc[0], "take": take, "drop": drop}))
        return pd.concat(found) if found else pd.DataFrame(columns=["step", "worker", "block", "rest", "values", "n", "take", "drop"])

    kinds = dict(rows.dtypes)
    each = _spread(dealt, folded, f"step {kinds['step']}, worker {kinds['worker']}, block int, rest double, values array<double>, n long, take long, drop long")
    whole = each.groupBy("step", "worker").agg(F.array_sort(F.collect_list(F.struct("block", "rest", "values"))).alias("v"), *(F.max(c).alias(c) for c in ("n", "take", "drop")))
    whole = whole.withColumn("values", F.array_sort(F.flatten(F.transform("v", lambda x: x["values"]))))
    summed = F.slice("values", F.lit(1), F.when(F.col("take") < F.col("drop"), F.col("take")).otherwise(F.size("values") - F.col("drop")).cast("int"))
    return whole.select("step", "worker", (total(F.transform("v", lambda x: x["rest"])) + total(summed)).alias("score"), "n")


def _far_by_blocks(rows: DataFrame, most: int, squared: bool, blocks: int, parts: int) -> DataFrame:
    """(step, x, y, d) for x < y: of each pair of blocks those pairs that are among the ``most`` farthest ones of either worker."""

    def farthest(part: pd.DataFrame) -> pd.DataFrame:
        x, a, y, b, same = _halves(part)
        d = _distances(a, b, squared, parts)
        if same:
            np.fill_diagonal(d, -1)
        far = np.zeros(d.shape, bool)
        for own, mark in ((d, far), (d.T, far.T)):
            if own.size:
                np.put_along_axis(mark, np.argpartition(own, max(own.shape[1] - most, 0), axis=1)[:, -most:], True, axis=1)
        i, j = np.nonzero(np.triu(far | far.T, 1) if same else far)
        width, s = -(-a.shape[1] // parts), np.zeros(len(i))
        with np.errstate(all="ignore"):
            for at in range(0, len(i), 4096):
                here = slice(at, at + 4096)
                for k in range(0, a.shape[1], width):
                    s[here] += ((a[i[here], k : k + width] - b[j[here], k : k + width]) ** 2).sum(axis=1)
        s = s if squared else np.sqrt(s)
        return pd.DataFrame({"step": part["step"].iloc[0], "x": np.minimum(x[i], y[j]), "y": np.maximum(x[i], y[j]), "d": np.where(np.isfinite(s), s, INF)})

    kinds = dict(rows.dtypes)
    return _spread(_by_blocks(rows, blocks), farthest, f"step {kinds['step']}, x {kinds['worker']}, y {kinds['worker']}, d double")


def neighbour_scores(rows: DataFrame, count: Callable[[Column], Column], squared: bool = False, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, worker, score, n, rank): the sum of the ``count(n)`` smallest distances to others; ranks from 1.

    With ``blocks`` or ``parts`` no pair leaves the task that computes it, once
    steps are large: what a worker's sums need is told block by block.
    """
    if _wide(rows, blocks, parts):
        scores = _scores_by_blocks(rows, count, squared, blocks, parts)
    else:
        near = pairs(rows, squared, blocks, parts)
        both = near.select("step", F.explode(F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.col("y").alias("i"), F.col("x").alias("j")))).alias("p"), "d").select("step", "p.i", "p.j", "d")
        own = Window.partitionBy("step", "i")
        ranked = both.withColumn("r", F.row_number().over(own.orderBy("d", "j"))).withColumn("n", F.count("*").over(own) + 1)
        scores = ranked.where(F.col("r") <= count(F.col("n"))).groupBy("step", F.col("i").alias("worker")).agg(F.sum("d").alias("score"), F.max("n").alias("n"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("step").orderBy(F.round("score", DIGITS), "worker")))


def krum_selection(rows: DataFrame, f: int, m: int | None = None, variant: str = "plain", blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, worker, score, rank) of the m workers with the lowest scores; m is n - f - 2 if it isn't given.

    ``plain`` sums n - f - 1 distances, ``squared`` n - f - 2 squared ones.
    ``blocks`` and ``parts`` spread a step over tasks, see ``pairs``.
    """
    squared = variant == "squared"
    scores = neighbour_scores(rows, lambda n: n - f - (2 if squared else 1), squared, blocks, parts)
    return scores.where(F.col("rank") <= (F.lit(m) if m else F.col("n") - f - 2)).select("step", "worker", "score", "rank")


def krum(rows: DataFrame, f: int, m: int | None = None, variant: str = "plain", blocks: int = 1, parts: int = 1) -> DataFrame:
    """Multi-krum: the mean of the selected vectors."""
    chosen = krum_selection(rows, f, m, variant, blocks, parts).select("step", "worker")
    return average(rows.join(chosen, ["step", "worker"], "left_semi"))


def bulyan_candidates(rows: DataFrame, f: int, m: int | None = None, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, i, pos, val): averages of sliding windows of the ranking, i from 0 to n - 2f - 3.

    Scores sum the m smallest distances.  Window i has ranks from i on, min(m, n - f - 2 - i) of them.
    """
    size = lambda n: F.lit(m) if m else n - f - 2
    scores = neighbour_scores(rows, size, blocks=blocks, parts=parts)
    i = F.explode(F.expr(f"sequence(0, cast(n as int) - {2 * f} - 3)"))
    windows = scores.select("step", "worker", "rank", "n", i.alias("i")).where((F.col("rank") > F.col("i")) & (F.col("rank") <= F.col("i") + F.least(size(F.col("n")), F.col("n") - f - 2 - F.col("i"))))
    vectors = windows.select("step", "worker", "i").join(rows.select("step", "worker", "g"), ["step", "worker"])
    return vectors.select("step", "i", F.posexplode("g").alias("pos", "val")).groupBy("step", "i", "pos").agg(F.avg("val").alias("val"))


def averaged_median(rows: DataFrame, drop: int, upper: bool = False) -> DataFrame:
    """(step, i, pos, val) -> (step, pos, val): the mean of the values closest to the lower median (or the upper one), all but ``drop`` of them.

    Of values equally close the one with the smaller i is taken first.  A
    coordinate's values are one array, so they are aggregated once and the rest
    is done within the row.
    """
    values = rows.groupBy("step", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "val"))).alias("v"))
    middle = F.expr(f"if(exists(v, x -> isnan(x.val)), double('NaN'), array_sort(transform(v, x -> x.val))[cast((size(v) - {0 if upper else 1}) / 2 as int)])")
    near = F.expr(f"slice(array_sort(transform(v, x -> struct(round(abs(x.val - mid), {DIGITS}) AS gap, x.i AS i, x.val AS val))), 1, greatest(size(v) - {drop}, 0))")
    kept = values.withColumn("mid", middle).select("step", "pos", near.alias("near")).where("size(near) > 0")
    return kept.select("step", "pos", (F.aggregate("near", F.lit(0.0), lambda s, x: s + x["val"]) / F.size("near")).alias("val"))


def bulyan(rows: DataFrame, f: int, m: int | None = None, blocks: int = 1, parts: int = 1) -> DataFrame:
    """Selection by neighbour scores, then a trimmed mean around the median of each coordinate."""
    return averaged_median(bulyan_candidates(rows, f, m, blocks, parts), 2 * f)


def pruned_picks(rows: DataFrame, f: int, m: int | None = None, blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, i, worker): the workers of each round of the rule whose scores forget each selected worker.

    A worker's score is the sum of its squared distances to its n - f - 2
    closest.  The scores of a step are the state of a fold: round i takes the
    workers with the lowest ones, max(1, m - i) of them if so many are left, and
    then removes the first of them from the scores that it is part of.
    """
    near = pairs(rows, True, blocks, parts)
    both = near.select("step", "x", "y", "d").unionByName(near.select("step", F.col("y").alias("x"), F.col("x").alias("y"), "d"))
    own = Window.partitionBy("step", "x")
    ranked = both.withColumn("r", F.row_number().over(own.orderBy("d", "y"))).withColumn("n", F.count("*").over(own) + 1).where(F.col("r") <= F.col("n") - f - 2)
    each = ranked.groupBy("step", F.col("x").alias("worker")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", F.col("y").alias("j"), "d"))).alias("near"))
    table = each.groupBy("step").agg(F.max("n").alias("n"), F.collect_list(F.struct("worker", F.expr("aggregate(near, 0D, (s, e) -> s + e.d)").alias("score"), "near")).alias("left"))
    kinds = dict(each.dtypes)
    left = f"array<struct<worker: {kinds['worker']}, score: double, near: {kinds['near']}>>"
    state = f"struct<left: {left}, picks: array<array<{kinds['worker']}>>>"
    most = m or f"(n - {f} - 2)"
    fold = f"""aggregate(sequence(0, cast(n as int) - {2 * f} - 3), cast(named_struct('left', left, 'picks', array()) as {state}), (acc, i) ->
      transform(array(array_sort(transform(acc.left, x -> struct(round(x.score, {DIGITS}) AS key, x.worker AS worker, x.score AS score, x.near AS near)))), o -> cast(named_struct(
        'left', transform(slice(o, 2, size(o)), x -> struct(x.worker, x.score - coalesce(get(filter(x.near, e -> e.j = o[0].worker), 0).d, 0D) AS score, x.near)),
        'picks', array_append(acc.picks, transform(slice(o, 1, cast(greatest(1, {most} - i) as int)), x -> x.worker))) as {state}))[0]).picks"""
    return table.select("step", F.posexplode(F.expr(fold)).alias("i", "picked")).select("step", "i", F.explode("picked").alias("worker"))


def bulyan_pruned(rows: DataFrame, f: int, m: int | None = None, blocks: int = 1, parts: int = 1) -> DataFrame:
    """The variant whose scores forget each selected worker: of the rounds' averages the n - 4f - 2 closest to the upper median are averaged.

    The distances of a step are one row, whose rounds are a fold; all else is keyed by coordinate.
    """
    vectors = pruned_picks(rows, f, m, blocks, parts).join(rows.select("step", "worker", "g"), ["step", "worker"])
    picked = vectors.select("step", "i", F.posexplode("g").alias("pos", "val")).groupBy("step", "i", "pos").agg(F.avg("val").alias("val"))
    return averaged_median(picked, 2 * f, upper=True)


def subsets(sizes: DataFrame, f: int) -> DataFrame:
    """Rows with ``n`` -> with ``i`` and ``at``: each choice of n - f of n places, from 0, in order, with its rank i.

    A choice is made from its rank alone, so no row knows the others, and a row
    with very many choices is dealt to all tasks.
    """
    k = F.col("n").cast("int") - f
    every = prefix.multiplied(sizes.where(k >= 0), choose(F.col("n").cast("int"), k), "i")
    return every.withColumn("at", members(F.col("n").cast("int"), k, F.col("i")))


def subset_diameters(rows: DataFrame, f: int, variant: str = "plain") -> DataFrame:
    """(step, i, workers, diameter) of every subset of n - f workers, exponentially many: what ``brute_selection`` is the minimum of."""
    sizes = rows.groupBy("step").agg(F.sort_array(F.collect_list("worker")).alias("ids")).withColumn("n", F.size("ids"))
    near = pairs(rows, variant == "squared").groupBy("step").agg(F.collect_list(F.struct("x", "y", "d")).alias("pairs"))
    each = subsets(sizes.join(near, "step", "left"), f).withColumn("workers", F.expr("transform(at, k -> ids[k])"))
    widest = F.expr("aggregate(filter(pairs, p -> array_contains(workers, p.x) AND array_contains(workers, p.y)), 0D, (s, p) -> greatest(s, p.d))")
    return each.select("step", "i", "workers", widest.alias("diameter"))


def brute_selection(rows: DataFrame, f: int, variant: str = "plain", blocks: int = 1, parts: int = 1) -> DataFrame:
    """(step, workers, diameter): the first of the subsets of n - f workers whose largest distance is smallest.

    ``squared`` takes squared distances, as ``krum`` does.

    The order of subsets is that of their sorted worker numbers.  Subsets with
    a distance that isn't finite are left out; a step without another gives no
    row.

    Subsets aren't listed.  Whatever is narrower than a set must lack one of the
    two workers that are farthest apart in it, so a tree that removes either of
    them, f levels deep, has every candidate: 2^(f+1) - 1 nodes a step.  A node
    that has removed fewer than f removes the largest workers, which gives the
    first of the subsets under it.  Only the f (n - 1) + 1 largest distances of
    a step are looked at, as f workers are part of no more than f (n - 1).  Of a
    worker that isn't removed f distances at most are to workers that are, so
    with ``blocks`` or ``parts`` the f + 1 largest of each are enough.
    """
    sizes = rows.groupBy("step").agg(F.sort_array(F.collect_list("worker")).alias("ids"))
    near = _far_by_blocks(rows, f + 1, variant == "squared", blocks, parts) if _wide(rows, blocks, parts) else pairs(rows, variant == "squared", blocks, parts)
    near = near.withColumn("key", F.round("d", DIGITS))
    far = near.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("key"), "x", "y"))).join(sizes.select("step", F.size("ids").alias("n")), "step").where(F.col("r") <= f * (F.col("n") - 1) + 1)
    edges = far.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("r", "key", "d", "x", "y"))).alias("far"))
    kind = dict(rows.dtypes)["worker"]
    clear = "filter(far, e -> NOT array_contains({gone}, e.x) AND NOT array_contains({gone}, e.y))"
    # Nodes as the sets of what they have removed, level by level: those of the level, and all so far.
    level = f"""flatten(transform(acc.now, gone -> transform(slice({clear.format(gone="gone")}, 1, 1), e -> array(array_append(gone, e.x), array_append(gone, e.y)))))"""
    state = f"struct<now: array<array<{kind}>>, every: array<array<{kind}>>>"
    root = f"cast(array(array()) as array<array<{kind}>>)"
    tree = f"aggregate(sequence(1, {f}), named_struct('now', {root}, 'every', {root}), (acc, k) -> transform(array(flatten({level})), now -> cast(named_struct('now', now, 'every', concat(acc.every, now)) as {state}))[0]).every" if f else root
    nodes = sizes.join(edges, "step").select("step", "ids", "far", F.explode(F.expr(tree)).alias("gone"))
    kept = nodes.withColumn("left", F.expr("filter(ids, w -> NOT array_contains(gone, w))"))
    # Those removed are f, so they are looked through and not all that stay; as a variable they are found once a node.
    removed = f"concat(gone, slice(left, size(ids) - {f} + 1, {f}))"
    widest = f"transform(array({removed}), out -> aggregate({clear.format(gone='out')}, cast(null as double), (s, e) -> greatest(s, e.d)))[0]"
    judged = kept.select("step", F.expr(f"slice(left, 1, size(ids) - {f})").alias("workers"), F.expr(widest).alias("diameter")).where(F.col("diameter") < INF)
    best = judged.groupBy("step").agg(F.min(F.struct(F.round("diameter", DIGITS).alias("key"), "workers", "diameter")).alias("b"))
    return best.select("step", "b.workers", "b.diameter")


def brute(rows: DataFrame, f: int, variant: str = "plain", blocks: int = 1, parts: int = 1) -> DataFrame:
    """Minimum-diameter averaging: the mean of the selected subset."""
    chosen = brute_selection(rows, f, variant, blocks, parts).select("step", F.explode("workers").alias("worker"))
    return average(rows.join(chosen, ["step", "worker"], "left_semi"))


def influence(rows: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """(step, influence): the share of arbitrary vectors (``is_byz``) in what a rule averages; all vectors without a selection."""
    used = rows if selection is None else rows.join(selection.select("step", "worker"), ["step", "worker"], "left_semi")
    return used.groupBy("step").agg(F.avg(F.col("is_byz").cast("double")).alias("influence"))


#: Rules by name: each takes (rows, f) and returns (step, pos, val).
RULES: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "average": lambda rows, f: average(rows),
    "median": lambda rows, f: median(rows),
    "krum": krum,
    "bulyan": bulyan,
    "brute": brute,
}


#: What a rule selects, (step, worker), for those that average some of the vectors; None where it takes all.
SELECTIONS: dict[str, Callable[[DataFrame, int], DataFrame] | None] = {
    "average": None,
    "krum": krum_selection,
    "brute": lambda rows, f, **options: brute_selection(rows, f, **options).select("step", F.explode("workers").alias("worker")),
}


def register(name: str, rule: Callable[[DataFrame, int], DataFrame], check: Callable[[int, int, int | None], str | None] | None = None, bound: Callable[[Column, Column], Column] | None = None, selection: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Add a rule of one's own; a name that is taken is refused.

    ``check`` takes (n, f, m) and says what is wrong with them, or nothing;
    ``bound`` makes a column of n and f; ``selection`` gives the (step, worker)
    that the rule averages, from which its influence follows.
    """
    if name in RULES:
        raise bounds.RuleError(f"there is a rule named {name} already")
    RULES[name], bounds.CHECKS[name] = rule, check
    if bound:
        bounds.BOUNDS[name] = bound
    if selection:
        SELECTIONS[name] = selection


def unregister(name: str) -> None:
    """Take a rule of one's own away again."""
    if name not in bounds.CHECKS:
        raise bounds.RuleError(f"{name} was not registered")
    for known in (RULES, bounds.CHECKS, bounds.BOUNDS, SELECTIONS):
        known.pop(name, None)


def influence_of(rows: DataFrame, rule: str, f: int, **options: object) -> DataFrame:
    """(step, influence) of a rule by name; one that doesn't average some of the vectors has none."""
    if rule not in SELECTIONS:
        raise bounds.RuleError(f"{rule} has no influence")
    select = SELECTIONS[rule]
    return influence(rows, select(rows, f, **options) if select else None)


def aggregate(rows: DataFrame, rule: str, f: int = 0, checked: bool = True, **options: object) -> DataFrame:
    """Apply a rule by name.  ``checked`` looks at the sizes of the steps first, which is one small job."""
    if rule not in RULES:
        raise bounds.RuleError(f"no rule is named {rule}; there are {', '.join(RULES)}")
    return RULES[rule](verify(rows, rule, f, options.get("m")) if checked else rows, f, **options)
