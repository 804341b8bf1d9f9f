"""Configuration, fusion, case and streaming queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import mask, scores, text
from evidentia.operators import cases, config, fusion
from evidentia.plans.lineage_plans import values
from evidentia.plans.search_plans import lines, table
from evidentia.streaming import watcher

KEYWORDS = ["ring", "widget", "bolt", "license"]


def impact_map_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts, brands and types does a requirement about KEYWORDS touch, with what evidence and confidence.

    Bridges: names (code), order lines (db), events (config), documents (rag) and labels (llm), each from its own
    table; all are aggregated to one row per target before they meet.
    """
    wanted = F.lit(False)
    for word in KEYWORDS:
        wanted = wanted | F.contains(F.lower("p_name"), F.lit(word))
    part = table(spark, sf_dir, "part").filter(wanted)
    name_score = F.when(F.lower("p_name").isin(*KEYWORDS), 1.0).otherwise(0.6)
    code = part.groupBy("p_name").agg(F.max(name_score).alias("score"), F.count("*").alias("n")).select(F.lit("code").alias("worker"), F.lit("METHOD").alias("kind"), F.col("p_name").alias("target"), "score")
    lines_of_part = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    mode = F.when(F.col("returns") > F.col("n") / 2, "literal").otherwise("concat")
    sold = lines_of_part.join(part, "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("returns"))
    db = sold.select(F.lit("db").alias("worker"), F.lit("SQL_TABLE").alias("kind"), F.col("p_brand").alias("target"), scores.db_score(mode, F.col("returns") == 0, F.col("n")).alias("score"))
    cfg = part.groupBy("p_type").agg(F.max("p_size").alias("size")).select(
        F.lit("config").alias("worker"), F.lit("CONFIG_KEY").alias("kind"), F.col("p_type").alias("target"), scores.config_score(F.lit(False), F.lit(""), F.when(F.col("size") > 45, "exact_match").otherwise("source_file")).alias("score")
    )
    candidates = code.unionByName(db).unionByName(cfg)
    relevance = (F.length("target") % 5) / 5.0
    votes = candidates.select(F.lit("llm").alias("worker"), "kind", "target", scores.vote_score(F.when(F.length("target") % 3 == 0, "oppose").otherwise("support"), relevance, F.lit(0.9)).alias("score"))
    rag = rag_scores(spark, sf_dir, candidates)
    fused = fusion.corroborated(fusion.aligned(candidates.unionByName(votes).unionByName(rag)))
    marked = fused.withColumn("folded", scores.folded(F.when(F.length("target") % 3 == 0, "oppose").otherwise("support"), F.lit("ok"), F.col("confidence_tier"), F.col("consensus_count")))
    top = fusion.capped_view(marked, 20)
    return top.select("kind", "target", "score_overall", "consensus_count", "confidence_tier", "folded", "place", scores.change_type(F.col("kind"), F.lit(False)).alias("change_type"))


def rag_scores(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    """The best score of a document line that names the target as a whole word; only SQL and config targets are looked for."""
    names = candidates.filter(F.col("kind").isin("SQL_TABLE", "CONFIG_KEY")).select("kind", "target", F.lower("target").alias("name"))
    asked = table(spark, sf_dir, "pages").select(F.lower("url").alias("text"), (F.lit(0.5) + (F.col("page_id") % 5) / 10.0).alias("score"))
    found = fusion.literal_scores(names.select("name"), asked)
    return names.join(found, "name").select(F.lit("rag").alias("worker"), "kind", "target", F.col("rag_score").alias("score"))


IMPACT_MAP_FLAGSHIP = r"""
WITH p AS (SELECT * FROM part WHERE regexp_matches(lower(p_name), 'ring|widget|bolt|license')),
code AS (SELECT 'METHOD' AS kind, p_name AS target, max(CASE WHEN lower(p_name) IN ('ring', 'widget', 'bolt', 'license') THEN 1.0 ELSE 0.6 END)::DOUBLE AS code FROM p GROUP BY p_name),
sold AS (SELECT p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS r FROM lineitem JOIN p ON p_partkey = l_partkey GROUP BY p_brand),
db AS (SELECT 'SQL_TABLE' AS kind, p_brand AS target, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN r > n / 2 THEN 1.0 ELSE 0.7 END::DOUBLE - CASE WHEN r = 0 THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN n >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE)), 4) AS db FROM sold),
cfg AS (SELECT 'CONFIG_KEY' AS kind, p_type AS target, CASE WHEN max(p_size) > 45 THEN 1.0 ELSE 0.4 END::DOUBLE AS config FROM p GROUP BY p_type),
c AS (SELECT kind, target, code, NULL::DOUBLE AS db, NULL::DOUBLE AS config FROM code UNION ALL SELECT kind, target, NULL, db, NULL FROM db UNION ALL SELECT kind, target, NULL, NULL, config FROM cfg),
v AS (SELECT *, CASE WHEN length(target) % 3 = 0 THEN 0.0 ELSE 0.5::DOUBLE * ((length(target) % 5) / 5.0::DOUBLE) + 0.5::DOUBLE * 0.9::DOUBLE END::DOUBLE AS llm FROM c),
u AS (SELECT ' ' || regexp_replace(lower(url), '[^a-z0-9_]+', ' ', 'g') || ' ' AS t, 0.5::DOUBLE + (page_id % 5) / 10.0::DOUBLE AS score FROM pages),
r AS (SELECT kind, target, max(score) AS rag FROM v JOIN u ON contains(u.t, ' ' || regexp_replace(lower(target), '[^a-z0-9_]+', ' ', 'g') || ' ') WHERE kind <> 'METHOD' GROUP BY kind, target),
a AS (SELECT v.*, coalesce(r.rag, 0) AS rag FROM v LEFT JOIN r USING (kind, target)),
s AS (SELECT *, CASE kind WHEN 'METHOD' THEN (code >= 0.6)::INT + (llm >= 0.6)::INT WHEN 'SQL_TABLE' THEN (db >= 0.6)::INT + (rag >= 0.6)::INT + (llm >= 0.6)::INT ELSE (config >= 0.6)::INT + (rag >= 0.6)::INT + (llm >= 0.6)::INT END AS consensus_count,
  CASE kind WHEN 'METHOD' THEN (0.25::DOUBLE * code + 0.1::DOUBLE * llm) / (0.25::DOUBLE + 0.1::DOUBLE) WHEN 'SQL_TABLE' THEN (0.2::DOUBLE * db + 0.15::DOUBLE * rag + 0.1::DOUBLE * llm) / (0.2::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE)
    ELSE (0.15::DOUBLE * config + 0.15::DOUBLE * rag + 0.1::DOUBLE * llm) / (0.15::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE) END AS w FROM a),
o AS (SELECT *, round(least(1.0::DOUBLE, w + CASE WHEN consensus_count >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE), 4) AS score_overall FROM s),
t AS (SELECT *, CASE WHEN score_overall >= 0.75 AND consensus_count >= 2 THEN 'HIGH' WHEN consensus_count = 1 OR score_overall >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE confidence_tier WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, consensus_count DESC, score_overall DESC, target)::INTEGER AS place FROM t)
SELECT kind, target, score_overall, consensus_count, confidence_tier, length(target) % 3 = 0 AND confidence_tier = 'LOW' AND consensus_count < 2 AS folded, place,
  CASE kind WHEN 'METHOD' THEN 'modify_method' WHEN 'SQL_TABLE' THEN 'db_config_change' ELSE 'config_change' END AS change_type FROM k WHERE place <= 20
"""


def bridge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: labels as votes, lines with hits as rag, length as db evidence."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hits = lines(spark, sf_dir).filter(F.contains(F.lower("line"), F.lit("the "))).groupBy("doc_id").agg(F.count("*").alias("hits"))
    kind = F.when(F.col("doc_id") % 3 == 0, "SQL_TABLE").when(F.col("doc_id") % 3 == 1, "CONFIG_KEY").otherwise("METHOD")
    joined = docs.join(labels, "doc_id").join(hits, "doc_id", "left")
    return joined.select(
        "doc_id", kind.alias("kind"), F.col("doc_id").cast("string").alias("target"), "toxic",
        F.when(F.col("lang") == "en", 1.0).otherwise(0.6).alias("code"),
        scores.db_score(F.when(F.col("n_chars") > 1000, "literal").otherwise("semicolon_split"), F.col("n_chars") % 2 == 0, F.coalesce("hits", F.lit(0))).alias("db"),
        scores.config_score(F.lit(False), F.lit(""), F.when(F.col("source") == "src1", "exact_match").otherwise("hierarchical_match")).alias("config"),
        F.least(F.coalesce("hits", F.lit(0)) / 10.0, F.lit(1.0)).alias("rag"),
        scores.vote_score(F.when(F.col("quality") == 1, "support").otherwise("oppose"), F.lit(0.8), F.lit(0.6)).alias("llm"),
    )


def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.corroborated(bridge_rows(spark, sf_dir)).select("kind", "target", "score_overall", "consensus_count", "confidence_tier")


BRIDGES_SQL = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, count(*) AS hits FROM l WHERE contains(lower(line), 'the ') GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'SQL_TABLE' WHEN 1 THEN 'CONFIG_KEY' ELSE 'METHOD' END AS kind, d.doc_id::VARCHAR AS target, toxic,
    CASE WHEN lang = 'en' THEN 1.0 ELSE 0.6 END::DOUBLE AS code,
    round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.3 END::DOUBLE - CASE WHEN n_chars % 2 = 0 THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN coalesce(hits, 0) >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE)), 4) AS db,
    CASE WHEN source = 'src1' THEN 1.0 ELSE 0.8 END::DOUBLE AS config, least(coalesce(hits, 0) / 10.0::DOUBLE, 1.0::DOUBLE) AS rag, CASE WHEN quality = 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS llm
  FROM documents d JOIN labels USING (doc_id) LEFT JOIN h ON h.doc_id = d.doc_id
), s AS (
  SELECT *, CASE kind WHEN 'METHOD' THEN (code >= 0.6)::INT + (llm >= 0.6)::INT WHEN 'SQL_TABLE' THEN (db >= 0.6)::INT + (rag >= 0.6)::INT + (llm >= 0.6)::INT ELSE (config >= 0.6)::INT + (rag >= 0.6)::INT + (llm >= 0.6)::INT END AS consensus_count,
    CASE kind WHEN 'METHOD' THEN (0.25::DOUBLE * code + 0.1::DOUBLE * llm) / (0.25::DOUBLE + 0.1::DOUBLE) WHEN 'SQL_TABLE' THEN (0.2::DOUBLE * db + 0.15::DOUBLE * rag + 0.1::DOUBLE * llm) / (0.2::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE)
      ELSE (0.15::DOUBLE * config + 0.15::DOUBLE * rag + 0.1::DOUBLE * llm) / (0.15::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE) END AS w FROM b
), o AS (SELECT *, round(least(1.0::DOUBLE, w + CASE WHEN consensus_count >= 2 THEN 0.1 ELSE 0.0 END::DOUBLE), 4) AS score_overall FROM s),
t AS (SELECT *, CASE WHEN score_overall >= 0.75 AND consensus_count >= 2 THEN 'HIGH' WHEN consensus_count = 1 OR score_overall >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier FROM o)"""
CONFIDENCE_TIERS = f"WITH {BRIDGES_SQL} SELECT kind, target, score_overall, consensus_count, confidence_tier FROM t"


def fold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.corroborated(bridge_rows(spark, sf_dir))
    hidden = scores.folded(F.when(F.col("toxic") == 1, "oppose").otherwise("support"), F.lit("ok"), F.col("confidence_tier"), F.col("consensus_count"))
    return rows.select("doc_id", hidden.alias("folded"))


FOLD_GATE = f"WITH {BRIDGES_SQL} SELECT doc_id, toxic = 1 AND confidence_tier = 'LOW' AND consensus_count < 2 AS folded FROM t"


def dimension_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.corroborated(bridge_rows(spark, sf_dir)).withColumn("is_fallback", F.col("config") < 0.9)
    return fusion.dimension_quality(rows)


DIMENSION_QUALITY = f"""
WITH {BRIDGES_SQL}, d AS (SELECT *, CASE kind WHEN 'METHOD' THEN 'method' WHEN 'SQL_TABLE' THEN 'sql_table' ELSE 'config' END AS dimension FROM t)
SELECT dimension, count(*) AS n, 'resolved' AS status, CASE WHEN dimension = 'config' AND bool_and(config < 0.9) THEN 'fallback_only' WHEN bool_or(confidence_tier = 'HIGH' OR consensus_count >= 2) THEN 'strong' ELSE 'low_confidence' END AS quality
FROM d GROUP BY dimension
"""


def vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "labels")
    score = scores.vote_score(F.when(F.col("quality") == 1, "support").otherwise("oppose"), F.lit(0.8), F.when(F.col("toxic") == 1, 0.2).otherwise(1.0))
    return votes.agg(F.count("*").alias("votes"), F.count_if(F.col("quality") == 1).alias("support"), F.count_if(F.col("quality") == 0).alias("oppose"), F.round(F.avg(score), 6).alias("run_score"))


VOTE_SUMMARY = """
SELECT count(*) AS votes, count(*) FILTER (quality = 1) AS support, count(*) FILTER (quality = 0) AS oppose,
  round(avg(CASE WHEN quality = 1 THEN 0.5::DOUBLE * 0.8::DOUBLE + 0.5::DOUBLE * CASE WHEN toxic = 1 THEN 0.2 ELSE 1.0 END::DOUBLE ELSE 0.0::DOUBLE END), 6) AS run_score FROM labels
"""


def config_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key of each event's JSON, with the type of its value."""
    parsed = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return parsed.select("event_id", "key", "value", text.value_type(F.col("value")).alias("value_type"))


CONFIG_FLATTEN = """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value,
  CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[-+]?[0-9]+$') THEN 'int' ELSE 'string' END AS value_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
"""


def config_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.concat_ws(".", F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")))
    entities = part.filter("p_size > 25").select(key.alias("entity_key")).distinct()
    refs = part.select(key.alias("ref_key")).unionByName(part.select(F.lower("p_type").alias("ref_key"))).unionByName(part.select(F.concat(key, F.lit(".x")).alias("ref_key"))).distinct()
    return config.bound(refs, entities)


CONFIG_BIND = """
WITH k AS (SELECT lower(p_type) AS t, lower(p_type) || '.' || replace(lower(p_brand), '#', '') AS key, p_size FROM part),
e AS (SELECT DISTINCT key FROM k WHERE p_size > 25), r AS (SELECT key AS ref FROM k UNION SELECT t FROM k UNION SELECT key || '.x' FROM k),
m AS (SELECT ref, key, CASE WHEN ref = key THEN 0 WHEN starts_with(ref, key || '.') THEN 1 ELSE 2 END AS way FROM r JOIN e ON ref = key OR starts_with(ref, key || '.') OR starts_with(key, ref || '.'))
SELECT ref AS ref_key, key AS entity_key, CASE way WHEN 0 THEN 'exact_match' ELSE 'hierarchical_match' END AS strategy
FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY way, CASE WHEN way = 1 THEN -length(key) ELSE 0 END, key) = 1
"""


def config_best_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.element_at(F.array(*map(F.lit, ["exact_match", "semgrep_rule", "ripgrep_fallback", "class_hint_package", "unknown"])), (F.col("l_linenumber") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("binding_id"), strategy.alias("bind_strategy"))
    return config.best_bindings(rows)


CONFIG_BEST_BINDING = """
WITH b AS (SELECT l_orderkey AS entity_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS binding_id,
  (['exact_match', 'semgrep_rule', 'ripgrep_fallback', 'class_hint_package', 'unknown'])[l_linenumber % 5 + 1] AS bind_strategy FROM lineitem),
w AS (SELECT *, CASE bind_strategy WHEN 'exact_match' THEN 1.0 WHEN 'semgrep_rule' THEN 0.8 WHEN 'ripgrep_fallback' THEN 0.4 WHEN 'class_hint_package' THEN 0.55 ELSE 0.3 END::DOUBLE AS weight FROM b)
SELECT entity_id, binding_id, bind_strategy, weight FROM w QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, binding_id) = 1
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.get_json_object("props", "$.k").alias("value"), "ts", "event_id")
    order = F.struct("ts", "event_id")
    a = rows.filter("dayofmonth(ts) <= 15").groupBy("key").agg(F.max_by("value", order).alias("value"))
    return a, rows.filter("dayofmonth(ts) > 15 and event_id % 3 <> 0").groupBy("key").agg(F.max_by("value", order).alias("value"))


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.difference(*snapshots(spark, sf_dir))


CONFIG_DIFF = """
WITH e AS (SELECT user_id::VARCHAR AS key, json_extract_string(props, '$.k') AS value, ts, event_id FROM events),
a AS (SELECT key, arg_max(value, (ts, event_id)) AS value FROM e WHERE day(ts) <= 15 GROUP BY key), b AS (SELECT key, arg_max(value, (ts, event_id)) AS value FROM e WHERE day(ts) > 15 AND event_id % 3 <> 0 GROUP BY key),
d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_in_a' WHEN a.key IS NULL THEN 'only_in_b' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS change, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b ON a.key = b.key)
SELECT * FROM d WHERE change IS NOT NULL
"""


def config_snapshot_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.summary_of(table(spark, sf_dir, "events"), "event_type")


CONFIG_SNAPSHOT_BIG = """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, 1::BIGINT AS distinct_keys FROM c UNION ALL SELECT '_summary', sum(n)::BIGINT, count(*) FROM c
"""


def config_snapshot_small_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    secret = mask.masked(F.col("c_name"))
    row = F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit(',"access_token":"'), secret, F.lit('"}'))
    return rows.select("c_custkey", row.alias("row_json"), mask.is_sensitive_key(F.lit("access_token")).alias("sensitive"))


CONFIG_SNAPSHOT_SMALL_MASKED = """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"access_token":"****' || right(c_name, 4) || '"}' AS row_json, TRUE AS sensitive FROM customer"""


def datasource_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")).alias("module"), F.col("s_nationkey").cast("string").alias("ds_user"))
    return config.without_conflicts(pairs, "module", ["ds_user"])


DATASOURCE_CONFLICTS = "SELECT 'm' || (s_suppkey % 40) AS module, min(s_nationkey::VARCHAR) AS ds_user FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1"


def owner_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("e"), (F.col("l_orderkey") % 500).cast("string")).alias("edge_id"), F.when(F.col("l_partkey") % 97 == 0, F.lit("A")).when(F.col("l_partkey") % 89 == 0, F.lit("B")).otherwise("").alias("owner"))
    return config.edge_owner(sides)


OWNER_RESOLUTION = """
WITH s AS (SELECT 'e' || (l_orderkey % 500) AS edge_id, CASE WHEN l_partkey % 97 = 0 THEN 'A' WHEN l_partkey % 89 = 0 THEN 'B' END AS owner FROM lineitem), g AS (SELECT edge_id, count(DISTINCT owner) AS n, max(owner) AS one FROM s GROUP BY edge_id)
SELECT edge_id, CASE WHEN n = 1 THEN one ELSE '' END AS owner, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM g
"""


def case_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a confirmation of the case that its first turn's whole text, folded, stands for."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("first")).select("conv_id", F.substring(F.sha2(text.folded_text(F.col("first.text")), 256), 1, 16).alias("case_id"))
    talk = rows.join(first, "conv_id").withColumn("day", F.col("turn") % 30)
    return cases.merged(talk, "case_id", "role", "role", "day")


CASE_MERGE = """
WITH f AS (SELECT conv_id, substr(sha256(lower(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')))), 1, 16) AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) WHERE n = 1),
c AS (SELECT case_id, role, turn % 30 AS day FROM conversations JOIN f USING (conv_id)),
k AS (SELECT case_id, role, count(*) AS n, max(day) AS day FROM c GROUP BY case_id, role)
SELECT case_id, sum(n)::BIGINT AS confirmations, string_agg(role || ':' || n, ',' ORDER BY role || ':' || n) AS by_kind, string_agg(role, ',' ORDER BY role) AS roles, max(day) AS last_day FROM k GROUP BY case_id
"""


def synonym_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_name").alias("term"), F.col("p_partkey").alias("at"))
    return cases.synonym_pool(rows, "tag", "term", "at")


SYNONYM_POOL = """
WITH f AS (SELECT p_brand AS tag, p_name AS term, min(p_partkey) AS pos FROM part GROUP BY 1, 2), l AS (SELECT tag, list(term ORDER BY pos, term) AS terms FROM f GROUP BY tag)
SELECT tag, terms[1] AS canonical, array_to_string(terms[2:], ',') AS variants FROM l
"""


def case_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = values(
        spark, "case_id string, signature string, root_cause string, note string, search_terms string, relation string",
        [("1", "slow  query", "missing index", "", "index", ""), ("2", "Slow query", "lock wait", "", "lock", ""), ("3", "slow query", "lock wait", "", "lock", "variant_of"), ("4", "new thing", "x", "mail a@b.org", "", ""), ("5", "other", "y", "", "", "")],
    )
    known = values(spark, "signature string, root_cause string", [("slow query", "Missing Index")])
    return cases.recorded(new, known)


CASE_RECORDER = "SELECT * FROM (VALUES ('1', 'confirm', NULL), ('2', 'conflict', NULL), ('3', 'relate', NULL), ('4', 'reject', 'email'), ('5', 'insert', NULL)) t(case_id, outcome, pii)"


def watcher_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    bursts = watcher.debounced(events, "2 hours", "user_id")
    return bursts.select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("flushed").alias("flushed_us"), "n_events")


WATCHER_DEBOUNCE = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 7200000000 AS flushed_us, count(*) AS n_events FROM s GROUP BY user_id, burst
"""


def requirement_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("yes"), F.count_if(F.col("role") == "system").alias("no"), F.max("turn").alias("turns"))
    scope = scores.scope_score(F.col("yes"), F.col("no"))
    confidence, assessment = scores.requirement_confidence(F.coalesce(scope, F.lit(0.0)), 1.0 / (1 + F.col("turns") % 3), F.lit(False))
    return talk.select("conv_id", F.round(confidence, 6).alias("confidence"), assessment.alias("assessment"))


REQUIREMENT_CONFIDENCE = """
WITH t AS (SELECT conv_id, count(*) FILTER (role = 'user') AS yes, count(*) FILTER (role = 'system') AS no, max(turn) AS turns FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN yes + no > 0 THEN yes::DOUBLE / (yes + no) ELSE 0.0 END AS scope, 1.0::DOUBLE / (1 + turns % 3) AS g FROM t)
SELECT conv_id, round(scope * g, 6) AS confidence, CASE WHEN scope < 0.5 THEN 'rejected' WHEN scope * g < 0.8 THEN 'degraded' ELSE 'accepted' END AS assessment FROM s
"""

_ALL = (
    impact_map_flagship, confidence_tiers, fold_gate, dimension_quality, vote_summary, config_flatten, config_bind, config_best_binding, config_diff, config_snapshot_big, config_snapshot_small_masked,
    datasource_conflicts, owner_resolution, case_merge, synonym_pool, case_recorder, watcher_debounce, requirement_confidence,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
