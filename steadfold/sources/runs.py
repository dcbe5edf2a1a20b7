"""Run logs: tables of steps in text files with tabs, and what is derived from them."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfold.functions.bounds import BOUNDS
from steadfold.sources.commits import Commits

STUDY = "step long, datapoints long, loss_avg double, l2_origin double, honest_dev double, attack_dev double, honest_norm double, attack_norm double, defense_norm double, honest_max double, attack_max double, defense_max double, cos_hon_att double, cos_hon_def double, cos_att_def double"
EVAL = "step long, accuracy double"

#: Training points of the known data sets.
TRAIN_SIZES = {"mnist": 60000, "fashionmnist": 60000, "cifar10": 50000, "cifar100": 50000}


def write(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("sep", "\t").option("header", False).csv(path)


def read(spark: SparkSession, path: str | list[str], schema: str = STUDY) -> DataFrame:
    """A log, a file or a folder of parts, or several of them; lines that begin with # are headers."""
    return spark.read.option("sep", "\t").option("comment", "#").option("recursiveFileLookup", True).schema(schema).csv(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object, in any file system that Spark knows; what is there is replaced."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Session:
    """A run's folder: its settings, and its study and evaluation logs by step.

    Of a folder with commits only what they name is read.  What can't be read is
    left out with a warning; ``data`` has what there is, a step that only one
    log has included.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.config = spark, folder, None
        if exists(spark, f"{folder}/config.json"):
            try:
                self.config = json.loads("".join(r.value for r in spark.read.text(f"{folder}/config.json").collect()))
            except ValueError as error:
                warnings.warn(f"{folder}: the settings can't be read ({error})", stacklevel=2)
        else:
            warnings.warn(f"{folder}: there are no settings", stacklevel=2)
        logs = [self._log("study", STUDY), self._log("eval", EVAL)]
        found = [x for x in logs if x is not None]
        self.data = join_session(*found) if len(found) == 2 else found[0] if found else None

    def _log(self, name: str, schema: str) -> DataFrame | None:
        if exists(self.spark, f"{self.folder}/commits"):
            paths = Commits(self.spark, self.folder).paths(name)
            return read(self.spark, paths, schema) if paths else self.spark.createDataFrame([], schema)
        if exists(self.spark, f"{self.folder}/{name}"):
            return read(self.spark, f"{self.folder}/{name}", schema)
        warnings.warn(f"{self.folder}: there is no {name} log", stacklevel=3)
        return None

    def get(self, *patterns: str) -> DataFrame:
        """The data, or only the columns whose names have one of the patterns."""
        return select_like(self.data, *patterns) if patterns else self.data

    def display(self, *patterns: str, rows: int = 20) -> Session:
        self.get(*patterns).orderBy("step" if not patterns else self.get(*patterns).columns[0]).show(rows, truncate=False)
        return self

    def has_known_ratio(self) -> bool:
        """Whether there is a bound for the rule of this run."""
        return bool(self.config) and self.config.get("rule") in BOUNDS

    def compute_epoch(self, points: int | None = None) -> Session:
        """Adds ``epoch``: data points over the training set's size, which is ``points`` or a known data set's."""
        size = F.col("datapoints") / F.lit(float(points)) if points else epoch(F.col("datapoints"), (self.config or {}).get("dataset", ""))
        self.data = self.data.withColumn("epoch", size)
        return self

    def compute_lr(self) -> Session:
        """Adds ``lr``, the learning rate by the settings' schedule."""
        c = self.config or {}
        if {"rate", "rate_decay", "rate_every"} <= c.keys():
            rate, decay, every = c["rate"], c["rate_decay"], c["rate_every"]
            column = F.lit(float(rate)) if decay <= 0 else F.lit(float(rate)) / (F.floor(F.col("step") / every) * every / F.lit(float(decay)) + 1)
        else:
            column = F.lit(None).cast("double")
        self.data = self.data.withColumn("lr", column)
        return self

    def compute_all(self) -> Session:
        """Everything that is computed from the data and the settings alone."""
        return self.compute_epoch().compute_lr()


def join_session(study: DataFrame, evaluation: DataFrame, *keys: str) -> DataFrame:
    """Both logs of a run by step; a step that only one of them has is kept."""
    return study.join(evaluation, [*keys, "step"], "full_outer")


def select_like(rows: DataFrame, *patterns: str) -> DataFrame:
    """The columns whose names have a pattern in them, whatever the case, in the order of the patterns, each once."""
    names = dict.fromkeys(c for p in patterns for c in rows.columns if p.lower() in c.lower())
    return rows.select(*names)


def discard_like(rows: DataFrame, *patterns: str) -> DataFrame:
    return rows.select(*(c for c in rows.columns if not any(p.lower() in c.lower() for p in patterns)))


def epoch(datapoints: Column, dataset: str) -> Column:
    """Data points over the size of the data set's training part; null for one that isn't known."""
    size = TRAIN_SIZES.get(dataset)
    return datapoints / F.lit(float(size)) if size else F.lit(None).cast("double")


def over_seeds(rows: DataFrame, *columns: str, key: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of each column by step (and ``by``), over rows in which none of them is null or NaN."""
    known = rows.dropna(subset=list(columns))
    return known.groupBy(*by, key).agg(F.count("*").alias("seeds"), *(x for c in columns for x in (F.avg(c).alias(f"{c}_avg"), F.stddev_pop(c).alias(f"{c}_err"))))


def band(rows: DataFrame, x: str, y: str, err: str, series: str) -> DataFrame:
    """(series, x, y, y_lo, y_hi): what a line with an error band is drawn from."""
    return rows.select(F.lit(series).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).alias("y"), (F.col(y) - F.col(err)).alias("y_lo"), (F.col(y) + F.col(err)).alias("y_hi"))


def histogram(rows: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """(bin, lo, hi, n) of equal widths between the smallest and the largest value; the last bin is closed, empty ones are there."""
    known = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    lo, hi = known.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return known.selectExpr("0L AS bin", "v AS lo", "v AS hi", "0L AS n").where("false")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counts = known.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * width).alias("lo"), (F.lit(lo) + (F.col("id") + 1) * width).alias("hi"))
    return every.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def parse_keyval(words: Column) -> Column:
    """An array of ``key:value`` texts as an array of structs (key, kind, value); kinds are bool, int, float or str."""

    def one(w: Column) -> Column:
        value = F.regexp_extract(w, "^[^:]*:(.*)$", 1)
        kind = F.when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^[+-]?[0-9]+$"), "int").when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float").otherwise("str")
        return F.struct(F.regexp_extract(w, "^([^:]*)", 1).alias("key"), kind.alias("kind"), value.alias("value"))

    return F.transform(words, one)
