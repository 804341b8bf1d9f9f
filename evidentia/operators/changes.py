"""Incremental plans: what changed between two states, and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(current: DataFrame, baseline: DataFrame, key: str = "key", digest: str = "digest") -> DataFrame:
    """(key, change): added, modified, deleted or same, by a full outer join of keys and digests."""
    now, before = current.select(key, F.col(digest).alias("__now"), F.lit(1).alias("__a")), baseline.select(key, F.col(digest).alias("__before"), F.lit(1).alias("__b"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "deleted").when(F.col("__now").eqNullSafe(F.col("__before")), "same").otherwise("modified")
    return now.join(before, key, "full").select(key, change.alias("change"))


def plan(changed: DataFrame, has_baseline: bool, same_fingerprint: bool, most_files: int = 500) -> DataFrame:
    """One row (mode, n_changed): noop, incremental or full."""
    n = F.count_if(F.col("change") != "same")
    mode = F.when(F.lit(not has_baseline or not same_fingerprint), "full").when(n == 0, "noop").when(n > most_files, "full").otherwise("incremental")
    return changed.agg(mode.alias("mode"), n.alias("n_changed"))


def replaced(table: DataFrame, files: DataFrame, fresh: DataFrame, key: str = "file") -> DataFrame:
    """The table without the rows of the files, plus the fresh rows."""
    return table.join(files.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def gates(counts: DataFrame, hard: list[str], soft: list[str], unresolved: float, mismatch: float) -> DataFrame:
    """(verdict): rollback for a hard table without rows or a sample that does not match, degraded for soft reasons."""
    empty_hard = F.max(F.when(F.col("table").isin(*hard) & (F.col("n") == 0), 1).otherwise(0))
    empty_soft = F.max(F.when(F.col("table").isin(*soft) & (F.col("n") == 0), 1).otherwise(0))
    verdict = F.when((empty_hard == 1) | F.lit(mismatch > 0.05), "keep_old").when((empty_soft == 1) | F.lit(unresolved > 0.15), "degraded").otherwise("ok")
    return counts.agg(verdict.alias("verdict"))
