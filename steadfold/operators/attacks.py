"""Vectors that an adversary would submit, made from the honest ones.

Each attack takes honest rows (step, worker, g) and returns ``f_real`` rows a
step, numbered after the honest workers: (step, worker, g, is_byz).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.functions.bounds import RuleError
from steadfold.functions.vectors import NAN
from steadfold.operators import kernels, rules, search
from steadfold.operators.rules import long_form, wide_form
from steadfold.sources import scratch

#: Fixed value: what an attack's factor is if none is given, a search with so many evaluations.
FACTOR = -search.EVALUATIONS


def _check(f_real: int, factor: float = 1.0, negative: bool = False) -> None:
    if isinstance(f_real, bool) or not isinstance(f_real, int) or f_real < 0:
        raise RuleError(f"f_real must be an integer of 0 or more, not {f_real!r}")
    if isinstance(factor, bool) or not isinstance(factor, (int, float)) or factor == 0 or isinstance(factor, float) and not factor > 0:
        raise RuleError(f"factor must be a positive number, or an integer below zero, not {factor!r}")
    if not isinstance(negative, bool):
        raise RuleError(f"negative must be true or false, not {negative!r}")


def _repeated(vectors: DataFrame, f_real: int) -> DataFrame:
    """(step, n, g) -> f_real rows of each, with worker numbers from n on."""
    copies = F.explode(F.expr(f"sequence(0, {f_real - 1})")) if f_real else F.explode(F.expr("cast(array() as array<int>)"))
    return vectors.select("step", "n", "g", copies.alias("k")).select("step", (F.col("n") + F.col("k")).cast("int").alias("worker"), "g", F.lit(True).alias("is_byz"))


def _sizes(honest: DataFrame) -> DataFrame:
    return honest.groupBy("step").agg(F.count("*").alias("n"), F.max(F.size("g")).alias("d"))


def nan(honest: DataFrame, f_real: int) -> DataFrame:
    """Vectors of NaN."""
    _check(f_real)
    return _repeated(_sizes(honest).select("step", "n", F.expr(f"array_repeat(double('{NAN}'), d)").alias("g")), f_real)


def _along_a_coordinate(target: int | str) -> Column:
    return F.lit(1.0) if target == "all" else F.when(F.col("pos") == F.expr(f"pmod({target}, d)"), 1.0).otherwise(0.0)


#: Directions by attack: of a target coordinate, a column over avg, dev, pos and d.
DIRECTIONS: dict[str, Callable[[int | str], Column]] = {
    "bulyan": _along_a_coordinate,
    "empire": lambda target: -F.col("avg"),
    "little": lambda target: F.col("dev"),
}


def ways(honest: DataFrame, attack: str, target: int | str = -1) -> DataFrame:
    """(step, n, pos, avg, way): the honest mean of each coordinate, and the attack's direction."""
    if attack not in DIRECTIONS:
        raise RuleError(f"no direction is named {attack}; there are {', '.join(DIRECTIONS)}")
    stats = long_form(honest).groupBy("step", "pos").agg(F.avg("val").alias("avg"), F.coalesce(F.stddev_samp("val"), F.lit(NAN)).alias("dev")).join(_sizes(honest), "step")
    return stats.select("step", "n", "pos", "avg", DIRECTIONS[attack](target).alias("way"))


def identical(honest: DataFrame, attack: str, f_real: int, factor: float = FACTOR, target: int | str = -1, negative: bool = False, f_decl: int | None = None, defence: str | None = None, compat: bool = False) -> DataFrame:
    """``f_real`` times the mean of the honest vectors plus ``factor`` times a direction.

    ``bulyan`` points along one coordinate or all, ``empire`` against the mean,
    ``little`` along the sample deviation of each coordinate, which is NaN for
    a single vector.  ``negative`` turns the direction round.

    A factor below zero is an integer: the factor of each step is searched for
    with so many evaluations, against the rule ``defence`` with ``f_decl``
    (``f_real`` if it isn't given).  ``compat`` submits what a search with
    ``negative`` has found on the other side of the mean, as the original does.
    """
    _check(f_real, factor, negative)
    stats = ways(honest, attack, target)
    if factor < 0 and f_real:
        found = auto(honest, attack, f_real if f_decl is None else f_decl, f_real, defence, -int(factor), negative, target)
        by = F.abs("factor") if compat else F.col("factor")
        stats = stats.join(found.select("step", by.alias("by")), "step")
    else:
        stats = stats.withColumn("by", F.lit(float(-factor if negative else factor)))
    return _repeated(wide_form(stats.select("step", "n", "pos", (F.col("avg") + F.col("by") * F.col("way")).alias("val")), "step", "n"), f_real)


def auto(honest: DataFrame, attack: str, f_decl: int, f_real: int, defence: str | None, evals: int = search.EVALUATIONS, negative: bool = False, target: int | str = -1) -> DataFrame:
    """(step, factor, gain): the factor that moves a rule's result farthest from the honest mean.

    A step's search is sequential.  Against a rule that has a kernel each step
    is one pandas group, whose vectors are all that a task holds; against
    another one, such as a rule of one's own, see ``auto_in_rounds``.
    """
    _check(f_real, -evals, negative)
    if defence not in rules.RULES:
        raise RuleError(f"a search needs a rule as its defence, one of {', '.join(rules.RULES)}, not {defence!r}")
    if defence not in kernels.KERNELS:
        return auto_in_rounds(honest, attack, f_decl, f_real, defence, evals, negative, target)
    rule, sign = kernels.KERNELS[defence], -1.0 if negative else 1.0

    def run(vectors: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(vectors.sort_values("worker")["g"].to_numpy())
        stats = stats.sort_values("pos")
        mean, way = stats["avg"].to_numpy(float), stats["way"].to_numpy(float)

        def gain(x: float) -> float:
            made = np.tile(mean + sign * x * way, (f_real, 1))
            return float(((rule(np.concatenate([g, made]), f_decl) - mean) ** 2).sum())

        best = search.maximum(gain, evals)
        return pd.DataFrame({"step": [vectors["of"].iloc[0]], "factor": [sign * best], "gain": [gain(best)]})

    stats = ways(honest, attack, target).select("step", "pos", "avg", "way")
    vectors = honest.select(F.col("step").alias("of"), "worker", "g")
    groups = vectors.groupBy("of").cogroup(stats.groupBy("step"))
    return groups.applyInPandas(run, f"step {dict(honest.dtypes)['step']}, factor double, gain double")


def auto_in_rounds(honest: DataFrame, attack: str, f_decl: int, f_real: int, defence: str, evals: int = search.EVALUATIONS, negative: bool = False, target: int | str = -1) -> DataFrame:
    """The same against any registered rule: all steps take their trials together, one job a trial.

    The state of the searches is a table with a row a step, written after each
    trial, so that no plan is longer than one trial's.
    """
    _check(f_real, -evals, negative)
    spark, sign, made = honest.sparkSession, F.lit(-1.0 if negative else 1.0), []

    def written(rows: DataFrame, label: str) -> DataFrame:
        made.append(scratch.folder(spark, label))
        rows.write.parquet(made[-1])
        return spark.read.schema(rows.schema).parquet(made[-1])

    stats = written(ways(honest, attack, target), "ways")
    vectors = honest.select("step", "worker", "g", F.lit(False).alias("is_byz"))

    def values(trials: DataFrame) -> DataFrame:
        """(step, trial, ...) -> with ``value``."""
        moved = stats.join(trials.select("step", "trial"), "step").select("step", "n", "pos", (F.col("avg") + sign * F.col("trial") * F.col("way")).alias("val"))
        found = rules.aggregate(vectors.unionByName(_repeated(wide_form(moved, "step", "n"), f_real)), defence, f_decl, checked=False)
        gap = found.join(stats.select("step", "pos", "avg"), ["step", "pos"]).groupBy("step").agg(F.sum((F.col("val") - F.col("avg")) * (F.col("val") - F.col("avg"))).alias("value"))
        return trials.join(gap, "step")

    fields = ("step", *search.State._fields)
    state = written(values(stats.select("step", F.lit(search.ORIGIN).alias("trial")).distinct()).withColumns(search.first_columns()).select(*fields), "search")
    for _ in range(evals - 1):
        tried = values(state.withColumn("trial", search.place_column()))
        state = written(tried.select("step", *(c.alias(k) for k, c in search.judged_columns().items())), "search")
    best = state.select("step", F.col("best").alias("trial"))
    found = written(values(best).select("step", (sign * F.col("trial")).alias("factor"), F.col("value").alias("gain")), "factors")
    for path in made[:-1]:
        scratch.drop(spark, path)
    return found


#: Attacks by name: each takes (honest, f_real, **options) and returns its rows.
ATTACKS: dict[str, Callable[..., DataFrame]] = {"nan": nan}
for _name in DIRECTIONS:
    ATTACKS[_name] = lambda honest, f_real, _name=_name, **options: identical(honest, _name, f_real, **options)


def register(name: str, attack: Callable[..., DataFrame]) -> None:
    """Add an attack of one's own; a name that is taken is refused."""
    if name in ATTACKS:
        raise RuleError(f"there is an attack named {name} already")
    ATTACKS[name] = attack


def made_by(honest: DataFrame, attack: str, f_real: int, checked: bool = False, **options: object) -> DataFrame:
    """The rows of an attack by name.  ``checked`` counts them: ``f_real`` in each step, or an error."""
    if attack not in ATTACKS:
        raise RuleError(f"no attack is named {attack}; there are {', '.join(ATTACKS)}")
    _check(f_real)
    found = ATTACKS[attack](honest, f_real, **options)
    if checked:
        counts = honest.select("step").distinct().join(found.groupBy("step").agg(F.count("*").alias("k")), "step", "left")
        if not counts.where(F.coalesce("k", F.lit(0)) != f_real).isEmpty():
            raise RuleError(f"the attack {attack} must make {f_real} vectors a step")
    return found


def with_attack(rows: DataFrame, attack: str, f_real: int, checked: bool = False, **options: object) -> DataFrame:
    """Rows with ``is_byz``: the arbitrary ones are replaced by what the attack makes of the others."""
    honest = rows.where("NOT is_byz").select("step", "worker", "g", "is_byz")
    return honest.unionByName(made_by(honest, attack, f_real, checked, **options))
