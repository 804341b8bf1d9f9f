"""Search and corpus queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import mask, text
from evidentia.operators import fusion, requirements, search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("container"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"))
    return search.symbols(parts, "ring", 100)


SYMBOL_SEARCH = """
WITH s AS (
  SELECT p_name AS name, p_brand AS container, 'part/' || p_partkey AS file,
    CASE WHEN p_name = 'ring' THEN 0 WHEN lower(p_name) = 'ring' THEN 1
      WHEN starts_with(lower(p_name), 'ring') THEN 2 WHEN contains(lower(p_name), 'ring') THEN 3 END AS match
  FROM part
), e AS (SELECT * FROM s WHERE match <= 1 ORDER BY match, name, file LIMIT 100),
f AS (SELECT * FROM s WHERE match > 1 ORDER BY match, name, file LIMIT 100)
SELECT name, container, file, match::INTEGER AS match, CASE WHEN match = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS name_match_strength
FROM (SELECT * FROM e UNION ALL SELECT * FROM f) ORDER BY match, name, file LIMIT 100
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines_of(table(spark, sf_dir, "documents"))


LINES = """
l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS lineno, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
)"""


def enclosing_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    hits = search.line_hits(rows, ["licen"]).select(F.col("doc_id").alias("file"), "lineno")
    sizes = rows.groupBy(F.col("doc_id").alias("file")).agg(F.max("lineno").alias("n"))
    classes = sizes.select("file", F.concat(F.lit("Doc"), F.col("file").cast("string")).alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    starts = sizes.filter("n >= 5").select("file", F.explode(F.sequence(F.lit(1), F.col("n") - 4, F.lit(5))).alias("start_line"))
    methods = starts.select("file", F.concat(F.lit("block"), F.col("start_line").cast("string")).alias("name"), F.lit("method").alias("kind"), "start_line", (F.col("start_line") + 4).alias("end_line"))
    return search.enclosing(hits, classes.unionByName(methods))


ENCLOSING_SCOPE = f"""
WITH {LINES}, n AS (SELECT doc_id, max(lineno) AS n FROM l GROUP BY doc_id),
h AS (SELECT doc_id, lineno FROM l WHERE contains(lower(line), 'licen'))
SELECT h.doc_id AS file, h.lineno AS lineno,
  CASE WHEN ((h.lineno - 1) // 5) * 5 + 5 <= n.n THEN 'block' || (((h.lineno - 1) // 5) * 5 + 1) ELSE 'Doc' || h.doc_id END AS scope
FROM h JOIN n USING (doc_id)
"""


def source_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.line_hits(lines(spark, sf_dir), ["the ", "license"])
    return search.capped_hits(hits, 20, 200).select("doc_id", "lineno", F.md5("line").alias("line_md5"), "hits_in_file", "file_truncated")


SOURCE_SEARCH_CAPPED = f"""
WITH {LINES}, h AS (
  SELECT doc_id, lineno, line, row_number() OVER (PARTITION BY doc_id ORDER BY lineno) AS place, count(*) OVER (PARTITION BY doc_id) AS hits_in_file
  FROM l WHERE contains(lower(line), 'the ') OR contains(lower(line), 'license')
)
SELECT doc_id, lineno, md5(line) AS line_md5, hits_in_file, hits_in_file > 20 AS file_truncated
FROM h WHERE place <= 20 ORDER BY doc_id, lineno LIMIT 200
"""


def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    first = search.line_hits(rows, ["license"]).groupBy("doc_id").agg(F.min("lineno").alias("lineno"))
    return search.passages(rows, first, 2).select("doc_id", "lineno", F.md5("passage").alias("passage_md5"))


PASSAGE_WINDOWS = f"""
WITH {LINES}, h AS (SELECT doc_id, min(lineno) AS lineno FROM l WHERE contains(lower(line), 'license') GROUP BY doc_id)
SELECT h.doc_id, h.lineno, md5(string_agg(l.line, chr(10) ORDER BY l.lineno)) AS passage_md5
FROM h JOIN l ON l.doc_id = h.doc_id AND l.lineno BETWEEN h.lineno - 2 AND h.lineno + 2 GROUP BY h.doc_id, h.lineno
"""


def rag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = text.tokens(F.lit("licensed under the general public license version"))
    rows = lines(spark, sf_dir)
    hits = search.line_hits(rows, ["license", "public"])
    scored = search.passages(rows, hits, 1).withColumn("score", F.round(text.overlap(query, text.tokens(F.col("passage"))), 6))
    best = search.best_passages(scored, 3)
    return best.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "lineno", "score", F.md5("passage").alias("passage_md5"))


RAG_TOPK = f"""
WITH {LINES}, q AS (SELECT ['licensed', 'under', 'the', 'general', 'public', 'license', 'version'] AS q),
h AS (SELECT doc_id, lineno FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'public')),
p AS (
  SELECT h.doc_id, h.lineno, string_agg(l.line, chr(10) ORDER BY l.lineno) AS passage,
    row_number() OVER (PARTITION BY h.doc_id ORDER BY h.lineno) AS place
  FROM h JOIN l ON l.doc_id = h.doc_id AND l.lineno BETWEEN h.lineno - 1 AND h.lineno + 1 GROUP BY h.doc_id, h.lineno
), s AS (
  SELECT doc_id, lineno, passage, place, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(passage), '[A-Za-z0-9_]+|[一-鿿]'))))::DOUBLE / len(q), 6) AS score FROM p, q
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lineno) AS best FROM s WHERE place <= 3
)
SELECT doc_id, lineno, score, md5(passage) AS passage_md5 FROM b WHERE best = 1 ORDER BY score DESC, doc_id LIMIT 10
"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = search.line_hits(text.lines_of(docs), ["the "]).groupBy("doc_id").agg(F.count("*").alias("n"))
    a = search.ranked(docs.select("doc_id", "n_chars"), F.desc("n_chars"), F.asc("doc_id")).select(F.lit("length").alias("path"), "rank", F.col("doc_id").alias("doc"))
    b = search.ranked(hits, F.desc("n"), F.asc("doc_id")).select(F.lit("hits").alias("path"), "rank", F.col("doc_id").alias("doc"))
    return fusion.rank_fusion(a.unionByName(b))


RRF_FUSION = f"""
WITH {LINES}, a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
h AS (SELECT doc_id, count(*) AS n FROM l WHERE contains(lower(line), 'the ') GROUP BY doc_id),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM h)
SELECT doc_id AS doc, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id
"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").first()["embedding"]  # one vector, the query
    return search.vectors_near(vectors, query, 10, "vec_id", "embedding")


VECTOR_TOPK = """
SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS distance
FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, v.vec_id LIMIT 10
"""


def stop_keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = F.concat(text.shouty_tokens(F.col("text")), text.camel_phrases(F.col("text")))
    return search.document_frequency(docs, terms, 5, 0.005)


CAMEL_SQL = "list_transform(regexp_extract_all(text, '[A-Z][a-z]+(?:[ -][A-Z][a-z]+)+'), lambda x: regexp_replace(x, '[ -]', '', 'g'))"
# each upper-case run is taken with its neighbours, so that none of a longer word is taken
SHOUTY_SQL = """list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z_0-9]{2,}'))"""
STOP_KEYWORD_CANDIDATES = f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(list_concat({SHOUTY_SQL}, {CAMEL_SQL}))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 5 AND count(*) / (SELECT count(*) FROM documents) >= 0.005
"""

STOP_WORDS = ["the", "and", "mit", "gnu"]


def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stop = F.array(*map(F.lit, STOP_WORDS))
    found = F.filter(F.array_distinct(F.concat(text.shouty_tokens(F.col("text")), text.camel_phrases(F.col("text")))), lambda x: ~F.array_contains(stop, F.lower(x)))
    return docs.select("doc_id", F.explode(found).alias("keyword"))


KEYWORD_EXTRACT = f"""
SELECT doc_id, keyword FROM (SELECT doc_id, unnest(list_distinct(list_concat({SHOUTY_SQL}, {CAMEL_SQL}))) AS keyword FROM documents)
WHERE lower(keyword) NOT IN ('the', 'and', 'mit', 'gnu')
"""


def language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) / F.greatest(F.length("text"), F.lit(1))
    return docs.select("doc_id", text.language(F.col("text")).alias("language"), F.round(other, 6).alias("other_ratio"), text.token_estimate(F.col("text")).alias("token_estimate"))


LANGUAGE_RATIO = """
WITH r AS (
  SELECT doc_id, text, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM documents
)
SELECT doc_id, CASE WHEN c + a = 0 OR c / (c + a) < 0.1 THEN 'en' WHEN c / (c + a) > 0.6 THEN 'zh' ELSE 'mixed' END AS language,
  round(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS other_ratio,
  floor(length(text) / 2.5)::BIGINT AS token_estimate
FROM r
"""


def prefilter_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", text.is_garbage(F.col("text"), ["add", "change"], 60, 0.9).alias("garbage"))


PREFILTER_GARBAGE = r"""
SELECT conv_id, turn, length(trim(text)) < 60 AND length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(text), 1) < 0.9
  AND NOT (contains(lower(text), 'add') OR contains(lower(text), 'change')) AS garbage FROM conversations
"""


def leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.without_excluded(table(spark, sf_dir, "documents"), "source", ["^src(1|7|1[0-9])$"]).groupBy("source").agg(F.count("*").alias("n"))


LEAKAGE_GATE = "SELECT source, count(*) AS n FROM documents WHERE NOT regexp_matches(source, '^src(1|7|1[0-9])$') GROUP BY source"


def sql_template_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("version")))
    return docs.orderBy("doc_id").limit(50).select("doc_id", text.excerpt(F.col("text"), 200).alias("snippet"))


SQL_TEMPLATE_SEARCH = "SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 200) AS snippet FROM documents WHERE contains(lower(text), 'version') ORDER BY doc_id LIMIT 50"


def grounding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms that the text really holds but for case and blanks, and their share."""
    docs = table(spark, sf_dir, "documents")
    terms = ["license", "version", "the of", "public license"]
    named = docs.select("doc_id", "text", F.posexplode(F.array(*map(F.lit, terms))).alias("at", "term"))
    kept = requirements.grounded(named, "text", "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "term"))).alias("kept"))
    found = docs.select("doc_id").join(kept, "doc_id", "left")
    grounded = F.coalesce(F.array_join(F.transform("kept", lambda x: x["term"]), ","), F.lit(""))
    return found.select("doc_id", grounded.alias("grounded"), (F.coalesce(F.size("kept"), F.lit(0)) / len(terms)).cast("double").alias("coverage"))


GROUNDING_FILTER = r"""
WITH f AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents),
h AS (SELECT doc_id, contains(t, 'license') AS a, contains(t, 'version') AS b, contains(t, 'theof') AS c, contains(t, 'publiclicense') AS d FROM f)
SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'license' END, CASE WHEN b THEN 'version' END, CASE WHEN c THEN 'the of' END, CASE WHEN d THEN 'public license' END) AS grounded,
  ((a::INT + b::INT + c::INT + d::INT) / 4)::DOUBLE AS coverage FROM h
"""


def pii_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mask.personal_data(F.col("text")).alias("pii")).filter("pii is not null")


PII_GATE = r"""
SELECT * FROM (SELECT doc_id, CASE
  WHEN regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') THEN 'email'
  WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])(?:86)?1[3-9][0-9]{9}(?:[^A-Za-z0-9_]|$)') THEN 'msisdn'
  WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:password|passwd|pwd|secret|token|credential|api[_-]?key)[ \t]*[=:][ \t]*[^ \t\n]+') THEN 'credential'
  WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])value_raw[ \t]*[=:][ \t]*[^ \t\n]+') THEN 'value_raw'
  WHEN regexp_matches(text, '(?i)(?:客户姓名|姓名|name)[ \t]*[:：=][ \t]*[^ \t\n]+') THEN 'name' END AS pii FROM documents) WHERE pii IS NOT NULL
"""


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in texts: quoted values of token= and the like, and e-mail names, are masked; the rest stays."""
    clean = F.regexp_replace(F.regexp_replace("text", r"(?i)(password|secret|token)([ ]*=[ ]*\")[^\"]*\"", '$1$2****"'), r"[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "****@$1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


REDACT_DOCUMENTS = r"""
WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)(password|secret|token)([ ]*=[ ]*")[^"]*"', '\1\2****"', 'g'), '[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '****@\1', 'g') AS clean FROM documents)
SELECT doc_id, md5(clean) AS clean_md5, clean <> text AS changed FROM c
"""


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


CONTENT_HASH_DEDUPE = "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


def hmac_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask.fingerprint(F.col("c_name"), b"salt").alias("fingerprint"))


def _padded(salt: bytes, by: int) -> str:
    """The key block of HMAC for DuckDB."""
    return "from_hex('" + bytes(x ^ by for x in salt.ljust(64, bytes(1))).hex() + "')"


HMAC_FINGERPRINT = f"""
SELECT c_custkey, sha256({_padded(b"salt", 0x5C)} || from_hex(sha256({_padded(b"salt", 0x36)} || encode(c_name)))) AS fingerprint FROM customer
"""

QUERIES = {
    "symbol_search": symbol_search, "enclosing_scope": enclosing_scope, "source_search_capped": source_search_capped, "passage_windows": passage_windows, "rag_topk": rag_topk,
    "rrf_fusion": rrf_fusion, "vector_topk": vector_topk, "stop_keyword_candidates": stop_keyword_candidates, "keyword_extract": keyword_extract, "language_ratio": language_ratio,
    "prefilter_garbage": prefilter_garbage, "leakage_gate": leakage_gate, "sql_template_search": sql_template_search, "grounding_filter": grounding_filter, "pii_gate": pii_gate,
    "redact_documents": redact_documents, "content_hash_dedupe": content_hash_dedupe, "hmac_fingerprint": hmac_fingerprint,
}
ORACLE_SQL = {
    "symbol_search": SYMBOL_SEARCH, "enclosing_scope": ENCLOSING_SCOPE, "source_search_capped": SOURCE_SEARCH_CAPPED, "passage_windows": PASSAGE_WINDOWS, "rag_topk": RAG_TOPK,
    "rrf_fusion": RRF_FUSION, "vector_topk": VECTOR_TOPK, "stop_keyword_candidates": STOP_KEYWORD_CANDIDATES, "keyword_extract": KEYWORD_EXTRACT, "language_ratio": LANGUAGE_RATIO,
    "prefilter_garbage": PREFILTER_GARBAGE, "leakage_gate": LEAKAGE_GATE, "sql_template_search": SQL_TEMPLATE_SEARCH, "grounding_filter": GROUNDING_FILTER, "pii_gate": PII_GATE,
    "redact_documents": REDACT_DOCUMENTS, "content_hash_dedupe": CONTENT_HASH_DEDUPE, "hmac_fingerprint": HMAC_FINGERPRINT,
}
