"""What a run writes, made known part by part: a part counts once a small file has named it.

Parts are written to places that nobody else has.  A commit is one small file,
written beside and then renamed, which names all parts that belong together,
such as a stretch of each log and the checkpoint behind it.  A run that dies
before the rename has written nothing that counts; one that dies after it has
written all of it.  Readers take what commits name, and nothing else.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from steadfold.sources import scratch


class Commits:
    """The commits of a folder, numbered from 0, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str) -> object:
        return self._hadoop.fs.Path(path)

    def _file(self, number: int) -> str:
        return f"{self.folder}/commits/{number:08d}.json"

    def numbers(self) -> list[int]:
        """What is committed, in order; files that aren't named as commits are don't count."""
        at = self._path(f"{self.folder}/commits")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def place(self, name: str) -> str:
        """A new path for a part, relative to the folder."""
        return f"{name}/{uuid.uuid4().hex}"

    def commit(self, parts: dict[str, object]) -> int:
        """Make parts known, all or none, under the next number; a number that another run has taken is an error."""
        number = (self.numbers() or [-1])[-1] + 1
        beside = f"{self.folder}/commits/.{uuid.uuid4().hex}"
        out = self._files.create(self._path(beside), False)
        try:
            out.write(bytearray(json.dumps(parts).encode()))
        finally:
            out.close()
        if self._files.exists(self._path(self._file(number))) or not self._files.rename(self._path(beside), self._path(self._file(number))):
            raise FileExistsError(f"commit {number} of {self.folder} is there already")
        return number

    def parts(self, number: int) -> dict[str, object]:
        """What a commit has made known."""
        lines = self.spark.read.text(self._file(number), wholetext=True).collect()
        return json.loads(lines[0].value)

    def last(self) -> dict[str, object] | None:
        numbers = self.numbers()
        return self.parts(numbers[-1]) if numbers else None

    def paths(self, name: str) -> list[str]:
        """Where the committed parts of that name are, in order."""
        found = (self.parts(n).get(name) for n in self.numbers())
        return [f"{self.folder}/{p}" for p in found if p]

    def forget(self, name: str, kept: int) -> None:
        """Remove the files of all but the last ``kept`` parts of that name, such as old checkpoints; the commits stay."""
        for path in self.paths(name)[: -kept or None]:
            scratch.drop(self.spark, path)
