"""New folders for files that the driver and all executors read and write."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own(application: str) -> str:
    """A temporary folder of this machine, which goes when Python ends."""
    path = tempfile.mkdtemp(prefix="steadfold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def root(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write.

    It is the one that ``spark.checkpoint.dir`` names.  Where that is unset a
    temporary folder serves, in local mode only: on a cluster the executors
    would not see it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own(spark.sparkContext.applicationId)


_made = threading.local()


def made() -> list[str]:
    """The paths that this thread has named so far, for those that remove them."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def folder(spark: SparkSession, label: str = "steadfold") -> str:
    """A new path under the shared folder."""
    made().append(f"{root(spark)}/{label}-{uuid.uuid4().hex}")
    return made()[-1]


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path with all that is in it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
