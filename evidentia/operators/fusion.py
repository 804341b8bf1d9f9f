"""Fusion of evidence from several bridges into scored, tiered and folded candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text

BRIDGES = ("code", "db", "config", "rag", "llm")


def literal_scores(names: DataFrame, snippets: DataFrame) -> DataFrame:
    """(name, rag_score): the best score among snippets that hold the name as a whole word, without regard to case.

    Snippets are cut into words and joined to the names on equality, so no pair of a name and a snippet is made
    without a match; a snippet goes by its hash there, and its text is fetched for the hits only. Names of several words
    are matched by their first word, then as a whole.
    """
    wanted = names.select(F.col("name"), F.lower("name").alias("low")).distinct().withColumn("word", F.regexp_extract("low", r"[a-z0-9_]+", 0)).filter("word <> ''")
    marked = snippets.select(F.lower("text").alias("low_text"), "score").withColumn("mark", F.xxhash64("low_text"))
    worded = marked.select("mark", F.explode(F.array_distinct(F.regexp_extract_all("low_text", F.lit(r"[a-z0-9_]+"), F.lit(0)))).alias("word"))
    near = worded.join(wanted, "word").select("mark", "name", "low").distinct()
    hit = near.join(marked, "mark").filter(F.concat(F.lit(" "), F.regexp_replace("low_text", r"[^a-z0-9_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace("low", r"[^a-z0-9_]+", " "), F.lit(" "))))
    return hit.groupBy("name").agg(F.max("score").alias("rag_score"))


def aligned(candidates: DataFrame) -> DataFrame:
    """One row per (kind, target) with a score column per bridge, from candidates(worker, kind, target, score)."""
    return candidates.groupBy("kind", "target").agg(*[F.max(F.when(F.col("worker") == b, F.col("score"))).alias(b) for b in BRIDGES])


def corroborated(rows: DataFrame) -> DataFrame:
    """Adds score_overall, consensus_count and confidence_tier to aligned rows."""
    overall, consensus = scores.weighted(F.col("kind"), {b: F.col(b) for b in BRIDGES})
    return rows.withColumns({"score_overall": overall, "consensus_count": consensus}).withColumn("confidence_tier", scores.tier(F.col("score_overall"), F.col("consensus_count")))


TIER_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "HIGH", 0).when(tier == "MEDIUM", 1).otherwise(2)


def capped_view(rows: DataFrame, per_group: int, group: str = "kind") -> DataFrame:
    """The best rows of each group by tier, consensus and score; ties by target."""
    order = Window.partitionBy(group).orderBy(tier_rank(F.col("confidence_tier")), F.desc("consensus_count"), F.desc("score_overall"), "target")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_group)


def strong_core(rows: DataFrame, strong: Column, group: str = "kind") -> DataFrame:
    """Only strong rows of each group, or all of them where none is strong."""
    kept = rows.withColumn("__strong", strong)
    return kept.withColumn("__any", F.max(F.col("__strong").cast("int")).over(Window.partitionBy(group))).filter(F.col("__strong") | (F.col("__any") == 0)).drop("__strong", "__any")


def dimension_quality(rows: DataFrame) -> DataFrame:
    """(dimension, n, status, quality): strong if any row is HIGH or has consensus, fallback_only if all are fallbacks."""
    placed = rows.withColumn("dimension", scores.dimension(F.col("kind"))).filter("dimension is not null")
    strong = (F.col("confidence_tier") == "HIGH") | (F.col("consensus_count") >= scores.CONSENSUS_BRIDGES)
    quality = (
        F.when((F.col("dimension") == "config") & F.bool_and(F.coalesce("is_fallback", F.lit(False))), "fallback_only")
        .when(F.bool_or(strong), "strong")
        .otherwise("low_confidence")
    )
    return placed.groupBy("dimension").agg(F.count("*").alias("n"), F.lit("resolved").alias("status"), quality.alias("quality"))


def best_of(rows: DataFrame, keys: list[str], score: Column, ingest: list[Column]) -> DataFrame:
    """The row of highest score for each key; the first ingested among equals."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *ingest))).filter("__n = 1").drop("__n")


def rank_fusion(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(doc, score) of reciprocal rank fusion over rankings(path, rank, doc)."""
    return rankings.groupBy("doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"))


def votes_in_chunks(candidates: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk, a running number of `size` candidates in each dimension."""
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))
    return candidates.withColumn("chunk", F.floor((place - 1) / size))


def overlap_of(query: Column, passage: Column) -> Column:
    return text.overlap(query, passage)


def view_counts(rows: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """(by, value, n): rows counted by each label; one that is a list counts each of its entries."""
    told = F.array(*[F.struct(F.lit(name).alias("by"), (col if name.endswith("s") else F.array(col)).alias("values")) for name, col in labels.items()])
    spread = rows.select(F.explode(told).alias("x")).select("x.by", F.explode("x.values").alias("value"))
    return spread.groupBy("by", "value").agg(F.count("*").alias("n"))
