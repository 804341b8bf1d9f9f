"""Builds of whole dimensions: gates before a swap, steps that fail apart, one builder at a time, run artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from evidentia.functions import mask, scores, text
from evidentia.operators import changes, config, evidence, requirements

# Signals that hold values, which no artifact may show.
VALUE_SIGNALS = ("value_raw", "value_columns", "enum_counts", "snapshot_sql", "db_snapshot", "snapshot_value", "raw_value", "sample_values")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table, in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def build_verdict(tables: dict[str, DataFrame], calls: DataFrame, hard: list[str], soft: list[str], mismatch: float = 0.0) -> DataFrame:
    """(verdict, unresolved) of new tables before they take the old ones' place: keep_old, degraded or ok.

    The share of unresolved calls is counted here, and so are the rows of the tables that must or should have some.
    """
    unresolved = evidence.unresolved_ratio(calls).first()["ratio"]
    verdict = changes.gates(table_counts(tables), hard, soft, unresolved, mismatch)
    return verdict.withColumn("unresolved", F.lit(unresolved))


def initialised(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(dimension, status, n, detail, verdict): each step builds a dimension's table, and one that fails stops no other.

    ok has rows, degraded has none, failed has the error's name; the verdict is ready if all are ok.
    """
    rows = []
    for name, step in steps.items():
        try:
            n = step().count()
            rows.append((name, "ok" if n else "degraded", n, "" if n else "no rows"))
        except Exception as error:  # noqa: BLE001  whatever fails in one dimension is reported and ends there
            rows.append((name, "failed", 0, type(error).__name__))
    verdict = "ready" if all(r[1] == "ok" for r in rows) else "degraded"
    return spark.createDataFrame([(*r, verdict) for r in rows], "dimension string, status string, n long, detail string, verdict string")


@contextmanager
def single_flight(spark: SparkSession, path: str) -> Iterator[bool]:
    """Whether this is the only builder just now; a lock file that the shared store creates for one of all who try."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        mine = bool(fs.createNewFile(target))
    except Exception:  # noqa: BLE001  some stores throw where the file is there already
        mine = False
    try:
        yield mine
    finally:
        if mine:
            fs.delete(target, False)


def run_artifact(candidates: DataFrame, path: str) -> None:
    """Write candidates as JSON; signals (maps) keep their names, and those that hold values lose these."""
    hidden = [
        F.transform_values(c, lambda k, v: F.when(k.isin(*VALUE_SIGNALS), "[redacted]").otherwise(v)).alias(c) if isinstance(candidates.schema[c].dataType, MapType) else F.col(f"`{c}`")
        for c in candidates.columns
    ]
    candidates.select(*hidden).write.mode("overwrite").json(path)


def breakdown(texts: DataFrame, votes: DataFrame, candidates: DataFrame, signals: list[str], id_col: str = "requirement_id") -> DataFrame:
    """(id, assessment, confidence, n_candidates, n_grounded, code_names) of requirement texts(id, raw_text).

    A blank text and garbage are rejected before anything is asked; votes(id, vote) say whether it is a requirement,
    and where none came it is degraded, not rejected. candidates(id, kind, term, source, source_span) are kept if their
    span is in the text; those found by patterns are, by their making. Upper-case tokens and phrases of the text are
    code names besides.
    """
    body = F.coalesce("raw_text", F.lit(""))
    base = texts.select(id_col, body.alias("raw_text"), ((F.btrim(body) == "") | text.is_garbage(body, signals)).alias("blank"))
    voted = votes.groupBy(id_col).agg(F.count_if(F.col("vote") == "yes").alias("yes"), F.count_if(F.col("vote") == "no").alias("no"))
    asked = candidates.join(base.filter("not blank"), id_col)
    found = requirements.grounded(asked.filter("source <> 'regex'"), "raw_text", "source_span").unionByName(asked.filter("source = 'regex'"))
    total = asked.groupBy(id_col).agg(F.count("*").alias("n_candidates"))
    kept = found.groupBy(id_col).agg(F.count("*").alias("n_grounded"), F.collect_set(F.when(F.col("kind") == "code", F.col("term"))).alias("named"))
    rows = base.join(voted, id_col, "left").join(total, id_col, "left").join(kept, id_col, "left").fillna(0, ["yes", "no", "n_candidates", "n_grounded"])
    scope = scores.scope_score(F.col("yes"), F.col("no"))
    coverage = F.when(F.col("n_candidates") == 0, 1.0).otherwise(F.col("n_grounded") / F.col("n_candidates"))
    confidence, assessment = scores.requirement_confidence(F.coalesce(scope, F.lit(0.0)), coverage, scope.isNull())
    own = F.concat(text.shouty_tokens(F.col("raw_text")), text.camel_phrases(F.col("raw_text")))
    names = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("named", F.array().cast("array<string>")))))
    out = F.when(F.col("blank"), "rejected").when(scope.isNull(), "degraded").otherwise(assessment)
    return rows.select(id_col, out.alias("assessment"), F.when(F.col("blank"), 0.0).otherwise(F.round(confidence, 6)).alias("confidence"), "n_candidates", "n_grounded", F.when(out == "rejected", F.array().cast("array<string>")).otherwise(names).alias("code_names"))


def config_dimension(items: DataFrame, references: DataFrame, edges: DataFrame, config_tables: DataFrame, salt: bytes) -> dict[str, DataFrame]:
    """The tables of the configuration dimension from items(source_id, key_path, value) and references(ref_key, class_fqn).

    entities by key, items with masked values and fingerprints (the last of a key in a source), bindings of references
    to entities, and edges marked where they lead into a table of configuration.
    """
    last = config.last_wins(items.withColumn("__key", F.struct("source_id", "key_path")), "__key", "value", "order").select("__key.*", "value")
    stored = last.withColumn("s", mask.sanitized_item(F.col("key_path"), F.col("value"), salt)).select("source_id", "key_path", F.col("s.value").alias("value"), "s.is_sensitive", "s.fingerprint")
    entities = stored.groupBy(F.col("key_path").alias("entity_key")).agg(F.count("*").alias("n_items")).withColumn("entity_id", mask.content_id("ent", F.col("entity_key")))
    bound = config.bound(references.select("ref_key").distinct(), entities)
    bindings = references.join(bound, "ref_key").select("entity_key", "class_fqn", "strategy").distinct()
    return {"items": stored, "entities": entities, "bindings": bindings, "edges": config.written_back(edges, config_tables)}
