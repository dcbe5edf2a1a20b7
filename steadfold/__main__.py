"""Training runs from the command line: ``python -m steadfold --train T --test U --results R --steps 300 --rule krum ...``.

T and U are Parquet tables of x (arrays of doubles) and y; every setting of a
run is an option of its name, and options that are tables are key:value words.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from steadfold.operators import experiment
from steadfold.sources.dataset import Batches


def value_of(text: str) -> object:
    """A word as a truth value, a whole number, a number, or itself."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def table_of(words: Sequence[str]) -> dict[str, object]:
    """``key:value`` words as a dict; a word without a colon, or a key that is there already, is an error."""
    found: dict[str, object] = {}
    for word in words:
        key, colon, value = word.partition(":")
        if not colon or key in found:
            raise argparse.ArgumentTypeError(f"{word!r} isn't key:value with a key of its own")
        found[key] = value_of(value)
    return found


def options_of(args: Sequence[str] | None = None) -> tuple[argparse.Namespace, experiment.Options]:
    parser = argparse.ArgumentParser(prog="steadfold", description="A training run by robust aggregation.")
    for name in ("train", "test", "results"):
        parser.add_argument(f"--{name}", required=True)
    plain = experiment.Options()
    for f in fields(plain):
        default, flag = getattr(plain, f.name), f"--{f.name.replace('_', '-')}"
        if isinstance(default, dict):
            parser.add_argument(flag, nargs="*", default=[])
        elif isinstance(default, bool):
            parser.add_argument(flag, action="store_true")
        elif f.name == "clip":
            parser.add_argument(flag, type=lambda x: None if x == "none" else float(x), default=default)
        else:
            parser.add_argument(flag, type=type(default), default=default)
    found = parser.parse_args(args)
    values = {f.name: getattr(found, f.name) for f in fields(plain)}
    return found, experiment.checked(experiment.Options(**{k: table_of(v) if isinstance(v, list) else v for k, v in values.items()}))


def main() -> None:
    paths, options = options_of()
    spark = SparkSession.builder.appName("steadfold").getOrCreate()
    train = Batches(spark.read.parquet(paths.train).select("x", "y"), options.batch, seed=options.seed, name="train")
    test = Batches(spark.read.parquet(paths.test).select("x", "y"), options.test_batch, seed=options.seed, wraps=False, name="test")
    width = train.placed.select(F.size("x")).first()[0]
    result = experiment.run(train, test, width, options, paths.results)
    print(json.dumps({"steps": len(result.study), "accuracy": result.evaluation[-1][1] if result.evaluation else None, "seconds": result.seconds}))


if __name__ == "__main__":
    main()
