"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import evidentia.llm

from . import alignment, fingerprints, licences, line_dedup, lm_scores, merkle, near_dedup, neighbours, packing, passages, quality, source_mix, token_counts
from .common import read

# Tasks carry the code with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(evidentia.llm)
cloudpickle.register_pickle_by_value(corpus_pipeline)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mix_sources(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_documents(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.dedup_lines(read(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digest(passages.drop_passages(read(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": op1_licence_scan,
    "op2_source_mix": op2_source_mix,
    "op3_nearest": op3_nearest,
    "op4_quality": op4_quality,
    "op5_lm_scores": op5_lm_scores,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_token_counts": op10_token_counts,
    "op11_passage_dedup": op11_passage_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

QUERIES["pipeline"] = corpus_pipeline.run


# Columns of the operators above that SQL can express, as queries of their own.


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 5).alias("target"))


MIX_TARGETS = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, (turn % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * total AS most FROM s),
o AS (SELECT *, (sum(total) OVER ())::DOUBLE - coalesce(sum(most) OVER below, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS weight_left FROM w
  WINDOW below AS (ORDER BY most / weight, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most / weight <= words_left / weight_left AS stops FROM o),
l AS (SELECT arg_min(words_left / weight_left, most / weight) AS level FROM c WHERE NOT stops)
SELECT doc_id, size, total AS source_size, round(CASE WHEN stops THEN most ELSE weight * level END, 5) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN l ON TRUE
"""


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm_scores(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


#: The fold is crc32 of the id's digits: DuckDB has none built in, so the training rows are told by a table of 256 steps.
LM_BASE_SCORES = """
WITH RECURSIVE b(i, k, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM b WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
d AS (SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT) AS digits, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: 'w' || x) AS words FROM documents),
f AS (SELECT doc_id, words, xor(list_reduce(list_prepend(4294967295::UBIGINT, digits), lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 7 = 2 AS held FROM d, steps),
w AS (SELECT doc_id, held, unnest(list_append(words, 'end')) AS word FROM f),
c AS (SELECT word, count(*) AS n FROM w WHERE NOT held GROUP BY word), s AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS kinds FROM c)
SELECT doc_id, count(*) AS n_tokens, count(c.n) AS n_known, any_value(total) AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 1)::DOUBLE / (total + kinds + 1))), 3) AS base_score
FROM w LEFT JOIN c USING (word), s GROUP BY doc_id
"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_TEXTS = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(next, 1, length(t) // 4)) AS edited_sha256 FROM n
"""

QUERIES |= {"mix_targets": mix_targets, "lm_base_scores": lm_base_scores, "edited_texts": edited_texts}

ORACLE_SQL: dict[str, str] = {
    "op3_nearest": neighbours.NEAREST_SQL,
    "op6_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op7_near_dedup": near_dedup.NEAR_DEDUP_SQL,
    "op11_passage_dedup": passages.PASSAGES_SQL,
    "op12_merkle_manifest": merkle.MERKLE_SQL,
    "mix_targets": MIX_TARGETS,
    "lm_base_scores": LM_BASE_SCORES,
    "edited_texts": EDITED_TEXTS,
}
