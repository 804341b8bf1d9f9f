"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, SparkSession] = {}
_OWN_FOLDER: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on one machine (tests) one
    of our own. On a cluster it must be set, as no local folder will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="evidentia-"))
    return f"file://{_OWN_FOLDER[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Lost executors then cost no recomputation of what came before, and a step that two branches use runs once.
    What discard() has not taken away goes when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidentia/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _SCRATCH:
        atexit.register(discard)
    _SCRATCH[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path  # for discard()
    return table


def discard(*tables: DataFrame) -> None:
    """Take away tables of written() that nothing reads any more, or all that are left."""
    paths = [t._scratch for t in tables] if tables else [*_SCRATCH]
    for path in paths:
        spark = _SCRATCH.pop(path, None)
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch space
            return


def fold_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_batches(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(task, schema)


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, kept in the Python worker for its later tasks until another is asked for (models and caches,
    not results): a worker that runs one operator after another never holds the caches of both."""
    kept = sys.modules.setdefault("_evidentia_worker", types.ModuleType("_evidentia_worker")).__dict__
    if kept.get("key") != key:
        kept["value"] = None
        kept["value"], kept["key"] = make(), key
    return kept["value"]


def text_runs(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(first, last, texts) of consecutive rows of about `most` bytes together; null counts as the empty text.

    Texts become Python strings a run at a time, so a batch of very many or long ones is not held twice.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for first, last in runs(sizes, most):
        yield first, last, [x or "" for x in column.slice(first, last - first).to_pylist()]


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) runs whose sizes add up to about `most`, so that a batch is bounded by bytes, not rows."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
