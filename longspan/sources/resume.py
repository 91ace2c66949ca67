"""Steps of a long job that a later application goes on from.

A step is a table named by the inputs' files, the job's parameters and its own. It is written to a
folder of its own attempt, which counts once Spark has put its `_SUCCESS` there, so an application
that is ended in the middle of a step leaves nothing that a later one would read, and two that run
at once do not disturb each other. Steps that are there are read and not built again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from longspan.sources.stages import save_table, shared_folder


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files at a path, listed and summed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{row[0]}:{row[1]}"


class Steps:
    """The steps of one job in `folder`, which every executor and later applications can reach."""

    def __init__(self, spark: SparkSession, folder: str, inputs: Sequence[str] = (), **parameters):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._base = [[fingerprint(spark, path) for path in inputs], parameters]
        self._used: dict[str, set[str]] = {}

    def step(self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None, **parameters) -> DataFrame:
        """The step's table: read if a finished attempt is there, else built, written and read."""
        told = json.dumps([name, self._base, parameters], sort_keys=True, default=str)
        key = hashlib.sha256(told.encode()).hexdigest()[:32]
        self._used.setdefault(name, set()).add(key)
        finished = self._finished(name, key)
        if finished is None:
            finished = f"{self.folder}/{name}/{key}/{uuid.uuid4().hex}"
            save_table(build(), finished, partition_by)
        return self.spark.read.parquet(finished)

    def drop_stale(self, older_than: float = 86_400) -> int:
        """Remove what this job's steps left under other keys or unfinished, and has not been
        touched for `older_than` seconds. Returns the number of folders removed."""
        removed = 0
        limit = (time.time() - older_than) * 1000
        for name, keys in self._used.items():
            for key in self._list(f"{self.folder}/{name}"):
                kept = self._finished(name, key.getName()) if key.getName() in keys else None
                attempts = self._list(key.toString())
                for attempt in attempts:
                    path = attempt.toString()
                    if path != kept and self._system(path).getFileStatus(attempt).getModificationTime() <= limit:
                        removed += self._system(path).delete(attempt, True)
                if key.getName() not in keys and not self._list(key.toString()):
                    self._system(key.toString()).delete(key, True)
        return removed

    def _finished(self, name: str, key: str) -> str | None:
        """The first finished attempt by name, so all readers take the same."""
        pattern = self._path(f"{self.folder}/{name}/{key}/*/_SUCCESS")
        found = self._system(pattern.toString()).globStatus(pattern) or []
        return min((status.getPath().getParent().toString() for status in found), default=None)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list:
        system = self._system(path)
        return [s.getPath() for s in system.listStatus(self._path(path))] if system.exists(self._path(path)) else []


def job_folder(spark: SparkSession, name: str) -> str:
    """A job's folder in the shared folder; other than scratch it is the same for all applications."""
    return f"{shared_folder(spark)}/longspan/jobs/{name}"
