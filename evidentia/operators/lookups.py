"""Point lookups over the evidence tables. Many keys are looked up at once: the wanted keys are a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import mask, text
from evidentia.operators import lineage, search


def configs(wanted: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Items of each wanted(key): those of that key, else those whose path holds it; with their entity; texts redacted."""
    exact = wanted.join(items, wanted["key"] == items["config_key"]).withColumn("how", F.lit("exact"))
    missed = wanted.join(items.select(F.col("config_key").alias("key")).distinct(), "key", "left_anti")
    # a key inside a path: the distinct paths that hold it, then their items
    pairs = search.contained(missed.select(F.col("key").alias("needle")), items.select(F.col("key_path").alias("text")))
    part = missed.join(pairs, missed["key"] == pairs["needle"]).drop("needle").join(items, F.col("text") == items["key_path"]).drop("text").withColumn("how", F.lit("path"))
    found = exact.unionByName(part)
    named = entities.select("entity_id", "entity_key", "entity_type")
    return found.join(named, "entity_id", "left").select("key", "how", "item_id", "key_path", mask.redacted(F.col("value_raw")).alias("value"), "entity_key")


def config_impact(wanted: DataFrame, entities: DataFrame, bindings: DataFrame) -> DataFrame:
    """Direct bindings of each wanted(entity_key)."""
    return wanted.join(entities, "entity_key").join(bindings, "entity_id").select("entity_key", "bind_type", "bind_target", "bind_strategy", mask.redacted(F.col("evidence")).alias("evidence"))


def rules(wanted: DataFrame, rule_sets: DataFrame, rule_bindings: DataFrame) -> DataFrame:
    """Rule sets of each wanted(name) with their bindings as a sorted list."""
    bound = rule_bindings.groupBy("rule_set_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bind_type", "bind_target", "bind_role"))), ",").alias("bindings"))
    return wanted.join(rule_sets, "name").join(bound, "rule_set_id", "left").select("name", "rule_set_id", "category", F.coalesce("bindings", F.lit("")).alias("bindings"))


def rule_logic(rule_sets: DataFrame, clauses: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule_set_id, n_clauses, sample_columns): key and value columns of the rule table, each once, in order."""
    columns = F.array_distinct(F.concat(*[F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in ("key_columns", "value_columns")]))
    counted = clauses.groupBy("rule_set_id").agg(F.count("*").alias("n_clauses"))
    joined = rule_sets.join(sources, "source_id", "left").join(counted, "rule_set_id", "left")
    return joined.select("rule_set_id", F.coalesce("n_clauses", F.lit(0)).alias("n_clauses"), F.array_join(columns, ",").alias("sample_columns"))


def tables(wanted: DataFrame, edges: DataFrame, columns: DataFrame, comments: DataFrame) -> DataFrame:
    """(table, edges_out, edges_in, columns, comment) of each wanted(table); nothing known gives zeros and blanks."""
    listed = columns.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]), ",").alias("columns"))
    found = wanted.join(lineage.degree(edges), "table", "left").join(listed, "table", "left").join(comments.select("table", "comment"), "table", "left")
    return found.select("table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges_out", "edges_in")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("columns", "comment")])


def dependents(wanted: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Objects that depend on each wanted(owner, name)."""
    on = (F.col("w.name") == F.col("d.referenced_name")) & ((F.col("w.owner") == "") | (F.col("w.owner") == F.col("d.referenced_owner")))
    return wanted.alias("w").join(dependencies.alias("d"), on).select(F.col("w.name").alias("name"), F.col("d.owner").alias("dependent_owner"), F.col("d.name").alias("dependent"), F.col("d.type").alias("type")).distinct()


def sequences(wanted: DataFrame, sequences_: DataFrame, templates: DataFrame, most: int = 50) -> DataFrame:
    """(sequence, last, code_refs): the first `most` statements that take a value of each wanted(sequence)."""
    used = templates.withColumn("sequence", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("sql_text"), F.lit(r"([A-Z_][A-Z0-9_$]*)\.(?:NEXTVAL|CURRVAL)"), F.lit(1)))))
    refs = used.groupBy("sequence").agg(F.array_join(F.slice(F.array_sort(F.collect_set("template_id")), 1, most), ",").alias("code_refs"))
    return wanted.join(sequences_, "sequence", "left").join(refs, "sequence", "left").select("sequence", "last", F.coalesce("code_refs", F.lit("")).alias("code_refs"))


def code(table: DataFrame, term: str, cap: int = 100) -> DataFrame:
    """Symbols for a term and its shorter forms; strength is against the term itself, the best match of a symbol stays."""
    spark = table.sparkSession
    forms = spark.range(1).select(text.term_expansions(F.lit(term)).alias("f")).first()["f"]
    found = None
    for form in forms:
        hits = search.symbols(table, form, cap).drop("name_match_strength")
        found = hits if found is None else found.unionByName(hits)
    strength = F.when(F.col("name") == term, 1.0).otherwise(0.6)
    return found.groupBy("name", "container", "file").agg(F.min("match").alias("match")).withColumn("name_match_strength", strength)


def symbol_source(wanted: DataFrame, methods: DataFrame, lines: DataFrame, most: int = 400) -> DataFrame:
    """(method_fqn, source, truncated): the redacted source lines of each wanted(method_fqn)."""
    at = wanted.join(methods, "method_fqn")
    inside = at.join(lines, "file").filter((F.col("lineno") >= F.col("start_line")) & (F.col("lineno") <= F.col("end_line")) & (F.col("lineno") < F.col("start_line") + most))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy("method_fqn").agg(mask.redacted(body).alias("source"), (F.max("end_line") - F.min("start_line") + 1 > most).alias("truncated"))


def health(counts: DataFrame, needed: list[str]) -> DataFrame:
    """(table, n, state) of each table that must have rows."""
    wanted = counts.sparkSession.createDataFrame([(t,) for t in needed], "table string")
    return wanted.join(counts, "table", "left").select("table", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.coalesce("n", F.lit(0)) > 0, "ready").otherwise("not_built").alias("state"))
