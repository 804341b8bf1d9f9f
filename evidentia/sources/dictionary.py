"""Dictionary views of many instances, read owner by owner in parallel, and what of them could not be read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import checkpointed
from evidentia.sources.files import readonly, refused_instance
from evidentia.sources.snapshots import SnapshotStore

#: (instance, owners, most rows) -> the rows of these owners there
Reader = Callable[[str, list[str], int], DataFrame]
REPORT = "instance string, owner string, n_rows long, status string, reason string"


class Scan(NamedTuple):
    """Rows of a view with `scanned_instance`, and a row per route that tells how its read went."""

    rows: DataFrame
    report: DataFrame


def jdbc_reader(spark: SparkSession, instances: dict[str, dict[str, str]], sql: str, owner_col: str) -> Reader:
    """Reads a view over JDBC; instances give the options (url, user, ...) by name. Only one SELECT or WITH is taken, and
    no url with a word of production. Each call is one read, one task; the limit is in the statement that is sent."""
    if not spark.range(1).select(readonly(F.lit(sql))).first()[0]:
        raise ValueError("refused: only one SELECT or WITH statement is allowed")
    for name, options in instances.items():
        if why := spark.range(1).select(refused_instance(F.lit(options["url"]), [options["url"]])).first()[0]:
            raise ValueError(f"refused: {name} is {why}")

    def read(instance: str, owners: list[str], most: int) -> DataFrame:
        options = instances[instance]
        mysql = options["url"].startswith(("jdbc:mysql:", "jdbc:mariadb:"))
        spelled = (o.replace("'", "''").replace("\\", "\\\\" if mysql else "\\") for o in owners)
        names = ", ".join(f"'{o}'" for o in spelled)
        end = f"LIMIT {most}" if mysql else f"FETCH FIRST {most} ROWS ONLY"
        sent = f"SELECT * FROM ({sql}) scanned WHERE {owner_col} IN ({names}) {end}"
        return spark.read.format("jdbc").options(**{"fetchsize": "10000"} | options).option("query", sent).load()

    return read


def dump_reader(dumps: dict[str, DataFrame], owner_col: str, order: list[str]) -> Reader:
    """Reads a view from a dump per instance; where the limit falls, the first rows by `order` are kept."""

    def read(instance: str, owners: list[str], most: int) -> DataFrame:
        return dumps[instance].filter(F.col(owner_col).isin(owners)).orderBy(*order).limit(most)

    return read


def scan(spark: SparkSession, read: Reader, routes: Iterable[tuple[str, str | None]], allowed: list[str], *, owner_col: str, group: int = 50, cap: int = 1_000_000) -> Scan:
    """A view of all routes (owner, instance); owners of one instance are read by groups, all groups in one job.

    A job that fails is taken apart: its groups are read again one by one, and the owners of a group that fails one by
    one, so that one owner out of reach costs no other its rows. A group of over cap rows an owner is read by single
    owners too; an owner of over cap rows by itself is cut there and says so. What has been read whole is never cut.
    status: ok, empty, truncated, or failed with the first line of the reason. An owner without an instance fails; an
    instance that may not be asked is an error before anything is read. Pairs given twice are read once. Without any
    rows to tell the columns from, `rows` has `scanned_instance` alone.
    """
    asked: dict[str, list[str]] = {}
    told: list[tuple] = []
    for owner, instance in sorted(set(routes), key=lambda r: (r[0], r[1] or "")):
        if instance is None:
            told.append((None, owner, 0, "failed", "no instance"))
        else:
            asked.setdefault(instance, []).append(owner)
    names = spark.createDataFrame([(n,) for n in asked], "name string")
    for name, why in names.select("name", refused_instance(F.col("name"), allowed).alias("why")).filter("why is not null").collect():
        raise ValueError(f"refused: {name} is {why}")

    parts = []
    for instance, owners in asked.items():
        jobs = [[owners[i : i + group] for i in range(0, len(owners), group)]]
        while jobs:
            reads = jobs.pop()
            try:
                each = [read(instance, g, cap * len(g) + 1).withColumn("scanned_read", F.lit(k)) for k, g in enumerate(reads)]
                part = checkpointed(reduce(DataFrame.unionByName, each))
                # as many rows as there are owners in these reads
                counted = part.groupBy("scanned_read", F.col(owner_col).alias("owner")).agg(F.count("*").alias("n")).collect()
            except (Py4JJavaError, PySparkException) as error:
                if len(reads) > 1:
                    jobs += [[g] for g in reads]
                elif len(reads[0]) > 1:
                    jobs += [[[o]] for o in reads[0]]
                else:
                    told.append((instance, reads[0][0], 0, "failed", first_line(error)))
                continue
            for k, g in enumerate(reads):
                found = {r["owner"]: r["n"] for r in counted if r["scanned_read"] == k}
                over = sum(found.values()) > cap * len(g)
                rows = part.filter(F.col("scanned_read") == k)
                if over and len(g) > 1:
                    jobs.append([[o] for o in g])
                    continue
                if over:
                    told.append((instance, g[0], cap, "truncated", f"over {cap} rows"))
                    rows = rows.limit(cap)
                else:
                    told += [(instance, o, found.get(o, 0), "ok" if o in found else "empty", None) for o in g]
                if found:
                    parts.append(rows.drop("scanned_read").withColumn("scanned_instance", F.lit(instance)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "scanned_instance string")
    return Scan(rows, spark.createDataFrame(told, REPORT))


def first_line(error: Exception) -> str:
    """What the database said: the message of the innermost cause."""
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        return str(cause.getMessage()).split("\n")[0]
    return str(error).split("\n")[0]


def refreshed(store: SnapshotStore, scans: dict[str, Callable[[], Scan]], required: set[str]) -> tuple[str | None, DataFrame]:
    """Scan all views and commit them, with `scan_report`, as the next version: (version, report with `view`).

    Nothing is committed, and the version is None, if a required view has a failed or a cut owner or no route at all: then
    the old version stands. The scans run one after another before anything is written. Another writer in between is a
    Conflict.
    """
    before = store.current()
    done = {name: run() for name, run in scans.items()}
    reports = [s.report.select(F.lit(name).alias("view"), "*") for name, s in done.items()]
    report = checkpointed(reduce(DataFrame.unionByName, reports))
    states = report.groupBy("view").agg(F.bool_or(F.col("status").isin("failed", "truncated")).alias("broken")).collect()
    whole = {r["view"] for r in states if not r["broken"]}
    if not required <= whole:
        return None, report
    return store.commit(store.write({name: s.rows for name, s in done.items()} | {"scan_report": report}), before), report
