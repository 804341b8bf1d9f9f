"""Session factory and session-level helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "evidentia", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session the cluster gives.

    Shuffle partitions follow the cores because the local inputs are small; AQE re-plans from there.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(df: DataFrame) -> str:
    """Where checkpoints go: spark.checkpoint.dir, or where that is unset on one machine (tests) a folder of our own. On a
    cluster it must be set, as no local folder will do."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidentia-checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage and the plan: df from files in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage and the plan as checkpointed(), by a compressed table, for rows that are many times the input. The
    table goes when the session's driver ends."""
    path = f"{shared_folder(df)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forgotten, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forgotten(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch space
        return


def parts_for(df: DataFrame, text_col: str, part_bytes: int = 1_000_000) -> int:
    """Partitions for work on a text's tokens: one for each part_bytes of text, which is counted, and as many as there are
    cores at least. Tokens take a hundred times the bytes of their compressed shuffle, by which Spark would merge them."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))


def met(parts: int, left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, both sides dealt by the keys into `parts` partitions. Spark sizes what is exploded or checkpointed
    by the files that it came from, so that it would send all of it through the driver as a broadcast."""
    return left.repartition(parts, *keys).join(right.repartition(parts, *keys).hint("merge"), keys, how)
