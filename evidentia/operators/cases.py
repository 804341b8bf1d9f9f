"""Confirmed cases and synonym pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import mask, text


def case_key(signature, root_cause):  # noqa: ANN001, ANN201
    return F.substring(F.sha2(F.concat_ws("|", text.folded_text(signature), text.folded_text(root_cause)), 256), 1, 16)


def merged(confirmations: DataFrame, key: str, kind: str, role: str, day: str) -> DataFrame:
    """(key, confirmations, roles, last_day, and a count per kind as key:n text) over all confirmations of a case."""
    by_kind = confirmations.groupBy(key, kind).agg(F.count("*").alias("n"), F.collect_set(role).alias("roles"), F.max(day).alias("day"))
    counters = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", kind, F.col("n")))), ",")
    return by_kind.groupBy(key).agg(
        F.sum("n").alias("confirmations"), counters.alias("by_kind"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))), ",").alias("roles"), F.max("day").alias("last_day")
    )


def recorded(new: DataFrame, known: DataFrame) -> DataFrame:
    """What recording each new case does: reject, insert, confirm, relate or conflict.

    Personal data in any searched field rejects. The same signature with the same cause confirms; with another cause it
    relates if a relation is given, else it is a conflict.
    """
    fields = [F.col(c) for c in ("signature", "root_cause", "note", "search_terms")]
    marked = new.withColumn("pii", mask.personal_data(*fields)).withColumn("sig", text.folded_text(F.col("signature"))).withColumn("cause", text.folded_text(F.col("root_cause")))
    old = known.groupBy(text.folded_text(F.col("signature")).alias("sig")).agg(F.collect_set(text.folded_text(F.col("root_cause"))).alias("causes"))
    outcome = (
        F.when(F.col("pii").isNotNull(), "reject").when(F.col("causes").isNull(), "insert").when(F.array_contains("causes", F.col("cause")), "confirm").when(F.coalesce("relation", F.lit("")) != "", "relate").otherwise("conflict")
    )
    return marked.join(old, "sig", "left").select("case_id", outcome.alias("outcome"), "pii")


def synonym_pool(rows: DataFrame, tag: str, term: str, order: str) -> DataFrame:
    """(tag, canonical, variants): the first term of each tag and the others in order, each once."""
    first = rows.groupBy(tag, term).agg(F.min(order).alias("at"))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("at", term))), lambda x: x[term])
    return first.groupBy(tag).agg(terms.alias("terms")).select(tag, F.element_at("terms", 1).alias("canonical"), F.array_join(F.slice("terms", F.lit(2), F.size("terms")), ",").alias("variants"))


def expanded(terms: DataFrame, rows: DataFrame, tag: str, term: str) -> DataFrame:
    """(term, synonym) for each of terms(term): every term of its tags, itself too; pairs of rows of one tag come only
    from the terms asked for."""
    known = rows.select(F.col(tag).alias("__tag"), F.col(term).alias("__term")).distinct()
    folded = known.withColumn("__folded", text.folded_text(F.col("__term")))
    asked = terms.select("term", text.folded_text(F.col("term")).alias("__folded")).distinct()
    tags = asked.join(folded, "__folded").select("term", "__tag").distinct()
    found = tags.join(known, "__tag").select("term", F.col("__term").alias("synonym"))
    return found.unionByName(terms.select("term", F.col("term").alias("synonym"))).distinct()
