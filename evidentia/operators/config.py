"""Configuration entities: bindings, differences, snapshots, identification, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores


def ancestors(key: Column) -> Column:
    """All dotted prefixes of a key, itself the last."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def bound(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref_key, entity_key, strategy): exact, else the longest ancestor, else the smallest descendant.

    Prefixes are exploded and joined on equality, both ways; no prefix predicate is left to a nested loop.
    """
    up = refs.select("ref_key", F.explode(ancestors(F.col("ref_key"))).alias("entity_key")).join(entities.select("entity_key").distinct(), "entity_key")
    down = entities.select("entity_key", F.explode(ancestors(F.col("entity_key"))).alias("ref_key")).join(refs.select("ref_key").distinct(), "ref_key").filter("ref_key <> entity_key")
    strategy = F.when(F.col("ref_key") == F.col("entity_key"), "exact_match").otherwise("hierarchical_match")
    found = up.select("ref_key", "entity_key", F.when(F.col("ref_key") == F.col("entity_key"), 0).otherwise(1).alias("way"), strategy.alias("strategy")).unionByName(
        down.select("ref_key", "entity_key", F.lit(2).alias("way"), F.lit("hierarchical_match").alias("strategy"))
    )
    best = F.min_by(F.struct("entity_key", "strategy"), F.struct("way", F.when(F.col("way") == 1, -F.length("entity_key")).otherwise(0), "entity_key")).alias("b")
    return found.groupBy("ref_key").agg(best).select("ref_key", "b.*")


def best_bindings(bindings: DataFrame) -> DataFrame:
    """Each entity's binding of greatest strategy weight; the first by id among equals."""
    weighed = bindings.withColumn("weight", scores.looked_up(F.col("bind_strategy"), scores.STRATEGY, 0.3))
    best = F.max_by(F.struct("binding_id", "bind_strategy", "weight"), F.struct("weight", -F.col("binding_id"))).alias("b")
    return weighed.groupBy("entity_id").agg(best).select("entity_id", "b.*")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, change, value_a, value_b) of two snapshots(key, value); keys without a change are left out."""
    left, right = a.select("key", F.col("value").alias("value_a"), F.lit(True).alias("in_a")), b.select("key", F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_b").isNull(), "only_in_a").when(F.col("in_a").isNull(), "only_in_b").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "changed")
    return left.join(right, "key", "full").select("key", change.alias("change"), "value_a", "value_b").filter("change is not null")


def summary_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, distinct_keys): counts by key and one summary row, in a single pass of grouping sets."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.lit("_summary").alias(key), F.sum("n").alias("n"), F.count("*").alias("distinct_keys"))
    return counted.select(key, "n", F.lit(1).cast("long").alias("distinct_keys")).unionByName(total)


def without_conflicts(pairs: DataFrame, module: str, values: list[str]) -> DataFrame:
    """Modules with one value in each column; a module with several is dropped."""
    spread = pairs.groupBy(module).agg(*[F.count_distinct(v).alias(f"__n_{v}") for v in values], *[F.min(v).alias(v) for v in values])
    kept = F.lit(True)
    for v in values:
        kept = kept & (F.col(f"__n_{v}") == 1)
    return spread.filter(kept).select(module, *values)


def owner_of_side(synonym: Column, direct: Column) -> Column:
    return F.struct(
        F.coalesce(synonym, direct, F.lit("")).alias("owner"),
        F.when(synonym.isNotNull(), "synonym").when(direct.isNotNull(), "direct").otherwise("needs_review").alias("how"),
    )


def edge_owner(resolved: DataFrame) -> DataFrame:
    """(edge_id, owner, status): one owner is resolved, several are ambiguous, none is unresolved."""
    grouped = resolved.groupBy("edge_id").agg(F.count_distinct(F.nullif("owner", F.lit(""))).alias("n"), F.max(F.nullif("owner", F.lit(""))).alias("only"))
    return grouped.select("edge_id", F.when(F.col("n") == 1, F.col("only")).otherwise("").alias("owner"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"))


def confirmed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without the rejected; a confirmation overrides the verdict."""
    return candidates.join(decisions, "name", "left").filter(F.coalesce("decision", F.lit("")) != "reject").withColumn("verdict", F.when(F.col("decision") == "confirm", "confirmed").otherwise(F.col("verdict"))).drop("decision")


def written_back(edges: DataFrame, config_tables: DataFrame) -> DataFrame:
    """Edges into a configuration table get that dataset type."""
    marks = config_tables.select(F.col("name").alias("dst_table")).distinct().withColumn("__hit", F.lit(True))
    return edges.join(marks, "dst_table", "left").withColumn("dst_dataset_type", F.when(F.col("__hit"), "CONFIG").otherwise(F.col("dst_dataset_type"))).drop("__hit")


def last_wins(items: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return items.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
