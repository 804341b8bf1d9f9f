"""Scoring formulae as column expressions; every score is a double in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, thresholds and kind sets that the results must agree with.
WEIGHTS = {"code": 0.25, "db": 0.20, "config": 0.15, "rag": 0.15, "dict": 0.15, "llm": 0.10}
CONSENSUS_BONUS = 0.10
HIGH_FROM, MEDIUM_FROM, CONSENSUS_FROM, CONSENSUS_BRIDGES = 0.75, 0.4, 0.6, 2
RECOVERY = {"literal": 1.0, "sql_file": 1.0, "local_var": 0.8, "static_const": 0.7, "concat": 0.7, "string_builder": 0.4, "semicolon_split": 0.3}
STRATEGY = {
    "exact_match": 1.0, "annotation_prefix_match": 0.85, "semgrep_rule": 0.8, "hierarchical_match": 0.8, "xml_id_match": 0.85, "class_hint_exact": 0.75,
    "class_hint_package": 0.55, "ripgrep_fallback": 0.4, "llm_inferred": 0.3, "llm_inferred + rag_corroborated": 0.45, "source_file": 0.4,
}
SQL_KINDS = ("SQL_TABLE", "SQL_COLUMN", "SQL_TEMPLATE")
CONFIG_KINDS = ("CONFIG_FILE", "CONFIG_KEY", "CONFIG_TABLE", "RULE_SET")
METHOD_KINDS = ("CLASS", "INTERFACE", "METHOD", "FIELD", "API_ENTRY", "JOB", "BATCH", "MSG")


def looked_up(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def clamped(x: Column) -> Column:
    """Into [0, 1]; null and NaN count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def number_of(x: Column) -> Column:
    """A signal as a double: text that is no number, NaN and infinities count as 0."""
    value = x.cast("string").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def db_score(mode: Column, branched: Column, evidence: Column) -> Column:
    base = looked_up(mode, RECOVERY, 0.4) - F.when(branched, F.lit(0.2)).otherwise(0.0) + F.when(evidence >= 2, F.lit(0.1)).otherwise(0.0)
    return F.round(clamped(base), 4)


def config_score(is_table: Column, owner: Column, strategy: Column) -> Column:
    table = F.when(F.coalesce(owner, F.lit("")) != "", F.lit(0.6)).otherwise(F.lit(0.4))
    return F.when(is_table, table).otherwise(looked_up(strategy, STRATEGY, 0.3))


def eligible(kind: Column) -> dict[str, Column]:
    """Which bridges may speak for a kind."""
    sql, config, method = kind.isin(*SQL_KINDS), kind.isin(*CONFIG_KINDS), kind.isin(*METHOD_KINDS)
    return {"code": method & ~sql & ~config, "db": sql, "config": config & ~sql, "rag": sql | config, "llm": F.lit(True)}


def weighted(kind: Column, scores: dict[str, Column]) -> tuple[Column, Column]:
    """(overall score, consensus) from bridge scores; an eligible bridge without a hit counts 0 and keeps its weight."""
    may = eligible(kind)
    total = consensus = weight = F.lit(0.0)
    for bridge, score in scores.items():
        on = may[bridge]
        total = total + F.when(on, F.lit(WEIGHTS[bridge]) * F.coalesce(score, F.lit(0.0))).otherwise(0.0)
        weight = weight + F.when(on, F.lit(WEIGHTS[bridge])).otherwise(0.0)
        consensus = consensus + F.when(on & (F.coalesce(score, F.lit(0.0)) >= CONSENSUS_FROM), 1).otherwise(0)
    consensus = consensus.cast("int")
    bonus = F.when(consensus >= CONSENSUS_BRIDGES, F.lit(CONSENSUS_BONUS)).otherwise(0.0)
    return F.round(clamped(total / weight + bonus), 4), consensus


def tier(score: Column, consensus: Column) -> Column:
    return (
        F.when((score >= HIGH_FROM) & (consensus >= CONSENSUS_BRIDGES), "HIGH")
        .when((consensus == 1) | (score >= MEDIUM_FROM), "MEDIUM")
        .otherwise("LOW")
    )


def folded(vote: Column, status: Column, tier_: Column, consensus: Column) -> Column:
    """Hidden only if the vote went through and opposes, and nothing else speaks for the candidate."""
    return F.coalesce((vote == "oppose") & (status == "ok") & (tier_ == "LOW") & (consensus < CONSENSUS_BRIDGES), F.lit(False))


def vote_score(vote: Column, relevance: Column, evidence: Column) -> Column:
    return F.when(vote == "support", 0.5 * clamped(relevance) + 0.5 * clamped(evidence)).otherwise(0.0)


def change_type(kind: Column, adds: Column) -> Column:
    return (
        F.when(kind == "METHOD", F.when(adds, "add_method").otherwise("modify_method"))
        .when(kind.isin("CLASS", "INTERFACE"), F.when(adds, "add_class").otherwise("modify_class"))
        .when(kind == "FIELD", "modify_class")
        .when(kind.isin(*SQL_KINDS), "db_config_change")
        .when(kind.isin(*CONFIG_KINDS), "config_change")
        .when(kind.isin("API_ENTRY", "JOB", "BATCH", "MSG"), "modify_method")
        .otherwise("unknown")
    )


def dimension(kind: Column) -> Column:
    return F.when(kind.isin(*METHOD_KINDS), "method").when(kind.isin(*SQL_KINDS), "sql_table").when(kind.isin(*CONFIG_KINDS), "config")


def config_table_fusion(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(score, verdict) from four signal paths: high from 0.6 with two paths, for review from 0.3."""
    score = F.round(0.4 * b + 0.3 * c + 0.2 * d + 0.1 * a, 4)
    paths = sum((F.when(x > 0, 1).otherwise(0) for x in (a, b, c, d)), F.lit(0))
    return score, F.when((score >= 0.6) & (paths >= 2), "high").when(score >= 0.3, "needs_review").otherwise("skip")


def requirement_confidence(scope: Column, grounding: Column, forced: Column) -> tuple[Column, Column]:
    """(confidence, assessment) of a parsed requirement."""
    score = clamped(scope) * clamped(grounding)
    return score, F.when(scope < 0.5, "rejected").when(forced | (score < 0.8), "degraded").otherwise("accepted")


def scope_score(yes: Column, no: Column) -> Column:
    """Share of yes among the decided samples; null when none was decided."""
    return F.when(yes + no > 0, yes / (yes + no))


def sequence_usage(last: Column, low: Column, high: Column) -> Column:
    """Percent of a sequence's span that is used, in decimals; null for a bad or empty span."""
    kind = "decimal(38,0)"
    a, b, c = (x.cast("string").try_cast(kind) for x in (last, low, high))
    return F.when(c - b > 0, F.round(((a - b) * 100).cast("double") / (c - b).cast("double"), 2))


def lineage_provider_score(matched: DataFrame, n_terms: int) -> DataFrame:
    """One row (n, score) over matched tables(recovery_mode, branched, has_comment, evidence_count)."""
    weight = looked_up(F.col("recovery_mode"), RECOVERY, 0.4) - F.when(F.col("branched"), F.lit(0.2)).otherwise(0.0)
    n = F.count("*")
    recall = F.least(F.lit(1.0), n / F.lit(max(1, n_terms))) if n_terms else F.when(n > 0, 1.0).otherwise(0.0)
    share = lambda hit: F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))
    score = 0.30 * recall + 0.25 * share(weight) + 0.20 * share(F.col("has_comment")) + 0.15 * share(F.col("evidence_count") >= 2)
    return matched.agg(n.alias("n"), F.round(F.least(F.lit(1.0), score), 4).alias("score"))


def config_provider_score(found: Column, expected: Column, quality: Column) -> Column:
    """With the two parts that are not measured yet at one half."""
    recall = F.least(found / F.greatest(expected, F.lit(1)), F.lit(1.0))
    return F.round(0.30 * recall + 0.25 * quality + 0.20 * 0.5 + 0.15 * 0.5, 4)


def code_provider_score(top_match: Column) -> Column:
    return F.round(0.9 * top_match, 4)


def mismatch_ratio(samples: DataFrame) -> DataFrame:
    """Share of samples(stored, found) that differ; 0 without samples."""
    return samples.agg(F.coalesce(F.avg((~F.col("stored").eqNullSafe(F.col("found"))).cast("double")), F.lit(0.0)).alias("mismatch"))
