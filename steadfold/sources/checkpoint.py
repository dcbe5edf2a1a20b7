"""Named states, kept in memory and in files; nothing that is there is replaced unless it is asked for."""

from __future__ import annotations

import json
from copy import deepcopy

import numpy as np
from pyspark.sql import SparkSession


def _written(value: object) -> object:
    if isinstance(value, np.ndarray):
        return {"array": value.ravel().tolist(), "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, dict):
        return {"dict": [[k, _written(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {"list": [_written(v) for v in value]}
    return value


def _read(value: object) -> object:
    if isinstance(value, dict):
        if "array" in value:
            return np.array(value["array"], float).reshape(value["shape"])
        if "dict" in value:
            return {k: _read(v) for k, v in value["dict"]}
        return [_read(v) for v in value["list"]]
    return value


class Checkpoint:
    """States by name: numbers, texts, numpy arrays, and lists and dicts of these."""

    def __init__(self) -> None:
        self.states: dict[str, object] = {}

    def snapshot(self, name: str, state: object, overwrite: bool = False) -> Checkpoint:
        """Keep a copy of a state."""
        if name in self.states and not overwrite:
            raise KeyError(f"there is a state named {name} already")
        self.states[name] = deepcopy(state)
        return self

    def restore(self, name: str) -> object:
        """A copy of a state; a name that isn't there is an error."""
        if name not in self.states:
            raise KeyError(f"no state is named {name}")
        return deepcopy(self.states[name])

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> Checkpoint:
        """Write the states, one row each, in any file system that Spark knows."""
        rows = [(k, json.dumps(_written(v))) for k, v in self.states.items()]
        spark.createDataFrame(rows, "name string, state string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        return self

    def load(self, spark: SparkSession, path: str, overwrite: bool = False) -> Checkpoint:
        """Read states; without ``overwrite`` only into a checkpoint that has none."""
        if self.states and not overwrite:
            raise KeyError("there are states already")
        self.states = {r.name: _read(json.loads(r.state)) for r in spark.read.schema("name string, state string").parquet(path).collect()}
        return self


class Storage(dict):
    """A dict whose entries are attributes too, and which a checkpoint can keep."""

    def __getattr__(self, name: str) -> object:
        if name not in self:
            raise AttributeError(name)
        return self[name]

    def __setattr__(self, name: str, value: object) -> None:
        self[name] = value
