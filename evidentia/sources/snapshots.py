"""Versioned tables: a full replacement becomes visible at once, or not at all."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Conflict(RuntimeError):
    """Another writer has committed, or is about to, since the version that this one started from."""


class SnapshotStore:
    """Tables in version folders, and pointer files, numbered in turn, of which the last names the current version.

    A new version is written beside the old one. It is committed only if the version it started from is still the
    current one: its number is claimed by making a file that must not be there, and then its pointer is renamed into
    place. Of two writers that started from the same version one is refused, and what it wrote is taken away. A failed
    build leaves the pointer, and with it every reader, where it was. A claim without a pointer, of a writer that died,
    holds others up for claim_seconds. That a file is made by one of two writers only is left to the file system.
    """

    def __init__(self, spark: SparkSession, root: str, claim_seconds: float = 600) -> None:
        self.spark, self.root, self.claim_seconds = spark, root.rstrip("/"), claim_seconds

    def current(self) -> str | None:
        rows = self.history()
        return rows[-1] if rows else None

    def _pointers(self) -> dict[int, str]:
        jvm, fs = _files(self.spark, self.root)
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        if not fs.exists(path):
            return {}
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return {int(n.split("-", 1)[0]): n.split("-", 1)[1] for n in names if n[0].isdigit()}

    def history(self) -> list[str]:
        return list(self._pointers().values())

    def replace(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a new version that follows the current one, and commit it; Conflict if that has changed."""
        expected = self.current()
        return self.commit(self.write(tables), expected)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a version that nobody sees yet."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        return version

    def commit(self, version: str, expected: str | None) -> str:
        """Make a written version the current one if `expected` still is (None: if there is none)."""
        jvm, fs = _files(self.spark, self.root)
        path = jvm.org.apache.hadoop.fs.Path
        try:
            pointers = self._pointers()
            number = max(pointers, default=-1) + 1
            if (pointers[number - 1] if pointers else None) != expected:
                raise Conflict(f"{expected} is no longer the current version")
            while fs.exists(claim := path(f"{self.root}/_claims/{number:09d}")):
                if time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 < self.claim_seconds:
                    raise Conflict(f"another writer is committing number {number}")
                number += 1
            try:
                fs.create(claim, False).close()
            except Py4JJavaError as error:
                if "AlreadyExists" not in str(error.java_exception):
                    raise
                raise Conflict(f"another writer has number {number}") from None
            if self.current() != expected:  # one that took over a dead claim may have come in between
                raise Conflict(f"{expected} is no longer the current version")
        except Conflict:
            fs.delete(path(f"{self.root}/{version}"), True)
            raise
        new = path(f"{self.root}/_current/_{version}")
        fs.create(new).close()
        if not fs.rename(new, path(f"{self.root}/_current/{number:09d}-{version}")):
            raise OSError(f"the pointer to {version} could not be renamed")
        return version

    def exists(self, name: str) -> bool:
        version = self.current()
        if not version:
            return False
        jvm, fs = _files(self.spark, self.root)
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{version}/{name}"))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current table; with a schema, an empty one where the table was never built."""
        if self.exists(name):
            return self.spark.read.parquet(f"{self.root}/{self.current()}/{name}")
        if schema is None:
            raise LookupError(f"there is no table {name}")
        return self.spark.createDataFrame([], schema)


def normalised(parts: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Rows of different columns as one table: missing columns are added, and nulls take their defaults."""
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, value in defaults.items():
        table = table.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in table.columns else F.lit(value))
    return table
