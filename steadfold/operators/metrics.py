"""Diagnostics of each step's honest, arbitrary and aggregated vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadfold.functions.bounds import bound
from steadfold.functions.vectors import NAN, largest, norm


def avg_dev_max(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, norm, dev, max): mean and sample deviation of the norms, 0 for one vector, and the largest absolute coordinate."""
    each = rows.select(*keys, norm(F.col("g")).alias("l"), largest(F.col("g")).alias("m"))
    dev = F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.stddev_samp("l"))
    return each.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l").alias("norm"), dev.alias("dev"), F.max("m").alias("max"))


def scalar_avg_dev(value: Column) -> tuple[Column, Column]:
    return F.avg(value), F.stddev_samp(value)


def study(rows: DataFrame, result: DataFrame, batch: int = 25) -> DataFrame:
    """A row a step of the study log, but for the columns that training adds.

    ``rows``: step, worker, g, is_byz; ``result``: step, pos, val.  Cosines are
    products of mean vectors over the mean norms; without arbitrary vectors
    what concerns them is NaN.
    """
    stats = avg_dev_max(rows, "step", "is_byz")
    honest = stats.where("NOT is_byz").select("step", F.col("n").alias("n_honest"), F.col("norm").alias("honest_norm"), F.col("dev").alias("honest_dev"), F.col("max").alias("honest_max"))
    attack = stats.where("is_byz").select("step", F.col("norm").alias("attack_norm"), F.col("dev").alias("attack_dev"), F.col("max").alias("attack_max"))
    means = long_form_by(rows).groupBy("step", "pos").agg(F.avg(F.when(~F.col("is_byz"), F.col("val"))).alias("h"), F.avg(F.when(F.col("is_byz"), F.col("val"))).alias("a"))
    products = means.join(result.select("step", "pos", F.col("val").alias("r")), ["step", "pos"]).groupBy("step").agg(
        F.sum(F.col("h") * F.col("a")).alias("ha"), F.sum(F.col("h") * F.col("r")).alias("hr"), F.sum(F.col("a") * F.col("r")).alias("ar"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("defense_norm"), F.max(F.abs("r")).alias("defense_max")
    )
    joined = honest.join(attack, "step", "left").join(products, "step")
    known = lambda c: F.coalesce(c, F.lit(NAN))
    cosine = lambda dot, x, y: known(F.try_divide(F.col(dot), F.col(x) * F.col(y)))
    return joined.select(
        "step", (F.col("step") * batch * F.col("n_honest")).cast("long").alias("datapoints"),
        "honest_dev", known(F.col("attack_dev")).alias("attack_dev"), "honest_norm", known(F.col("attack_norm")).alias("attack_norm"), "defense_norm",
        "honest_max", known(F.col("attack_max")).alias("attack_max"), "defense_max",
        cosine("ha", "honest_norm", "attack_norm").alias("cos_hon_att"), cosine("hr", "honest_norm", "defense_norm").alias("cos_hon_def"), cosine("ar", "attack_norm", "defense_norm").alias("cos_att_def"),
    )


def long_form_by(rows: DataFrame) -> DataFrame:
    return rows.select("step", "is_byz", F.posexplode("g").alias("pos", "val"))


def bound_satisfied(rows: DataFrame, rule: str, f: int) -> DataFrame:
    """(step, ratio, bound, satisfied): the honest vectors' deviation over their norm against the rule's bound."""
    stats = avg_dev_max(rows.where("NOT is_byz"), "step")
    sizes = rows.groupBy("step").agg(F.count("*").alias("all"))
    ratio = F.try_divide(F.col("dev"), F.col("norm"))
    limit = bound(rule, F.col("all"), F.lit(f))
    return stats.join(sizes, "step").select("step", ratio.alias("ratio"), limit.alias("bound"), (ratio <= limit).alias("satisfied"))


