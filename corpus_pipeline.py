"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes each stage's
result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import line_dedup, near_dedup, packing, quality, source_mix
from evidentia.llm.common import read, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from labelled rows outside the held-out fold.

    Each row is judged by its own text; null and empty texts are judged as padding. Repeated rows and ids share a fate
    if their texts are equal. An empty table stays empty; without labels the untrained network rejects all. Other
    columns are kept as they are.
    """
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.classify(docs, net, keep=True)
    return scored.filter("__predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; n_chars follows the text.

    Every row stays. A null text becomes an empty one; rows of one id count as one document, a null id as one below all.
    """
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near-duplicates, once; documents of a null id stay.

    Null, empty and blank texts are like nothing and stay. Of an id's several rows the one of least text hash stays.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = docs.join(kept, "doc_id").withColumn("__place", place).filter("__place = 1").select(*docs.columns)
    return one.unionByName(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it, which may be never.

    Rows of size 0 (null and blank texts) are taken with the whole part of their source's rate; a null source is one of
    its own. Rows that agree in id, source and text are taken alike.
    """
    return source_mix.mixed_rows(docs, source_mix.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row, packed into sequences; repeated rows and null ids are packed row by row, and a null or
    empty text is one end token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: No SQL expresses the network, the random draws or the search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
