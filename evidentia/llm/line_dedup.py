"""Line dedup with DataFrame functions: explode normalised lines, hash, count documents per hash, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z lower-cased (other letters as they are)."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is quick and right where every character is one byte; translate() is right everywhere
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that many documents share, except in the largest id that holds them.

    Returns the input's columns with the text's remaining lines joined by newlines, and n_lines, n_dropped (which
    replace input columns of these names). A key is the line stripped of ASCII blanks and lower-cased in A-Z; keys of
    at least min_chars code points found in at least min_docs different ids lose their lines everywhere but in the
    largest id. Null and empty texts are one empty line and give an empty text. Rows of the same id count as one
    document. A null id counts as a document below all others. An empty table gives no rows.

    Texts are split and hashed once: only 128-bit hashes, ids and line numbers are written, counted and joined. Counting
    is combined before the shuffle, so a line that a third of all documents hold is a few rows by then. Lines that make
    up over a thousandth of all shared ones are a thousand at most: these are found by a broadcast, and only the others,
    none of which is hot, by a join on the hash.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    body = F.coalesce(F.col(text_col), F.lit(""))
    who = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    base = docs.select(*names).withColumns({"__who": who, "__text_hash": F.xxhash64(body)})

    exploded = base.select("__who", "__text_hash", F.posexplode(F.split(body, "\n")).alias("__at", "__line"))
    keyed = exploded.select("__who", "__text_hash", "__at", line_key(F.col("__line")).alias("__key")).filter(F.length("__key") >= min_chars)
    hashed = written(keyed.select("__who", "__text_hash", "__at", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), F.col("__key")).alias("__h2")), "lines")
    shared = written(
        hashed.groupBy("__h1", "__h2")
        .agg(F.count_distinct("__who").alias("__docs"), F.max("__who").alias("__keeper"), F.count("*").alias("__lines"))
        .filter(F.col("__docs") >= min_docs)
        .select("__h1", "__h2", "__keeper", "__lines"),
        "shared",
    )
    # keys of more than a thousandth of all lines that go or stay: a thousand at most, so that they can be broadcast
    total = shared.agg(F.sum("__lines")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("__lines") * 1000 > total).select("__h1", "__h2", F.col("__keeper").alias("__hot")))
    marked = hashed.join(hot, ["__h1", "__h2"], "left")
    rare = marked.filter("__hot is null").join(shared.filter(F.col("__lines") * 1000 <= total), ["__h1", "__h2"])
    found = marked.filter("__hot is not null").select("__who", "__text_hash", "__at", F.col("__hot").alias("__keeper")).unionByName(rare.select("__who", "__text_hash", "__at", "__keeper"))
    doomed = found.filter(F.col("__who") != F.col("__keeper")).groupBy("__who", "__text_hash").agg(F.collect_set("__at").alias("__doomed"))
    lines = F.split(body, "\n")
    joined = base.join(doomed, ["__who", "__text_hash"], "left")
    # array_except works by hash, so that a text of very many lines costs its length and no more
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__doomed"))
    text = F.when(F.col("__doomed").isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__doomed"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digest(deduped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of what dedup_lines returns."""
    return deduped.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.pos, k.line, (hot.key IS NOT NULL AND k.doc_id <> hot.keeper) AS gone
  FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
