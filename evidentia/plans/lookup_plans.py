"""Point lookups over the test tables and literal rows, with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import lookups
from evidentia.plans.lineage_plans import BRAND_EDGES, deduped_edges, values
from evidentia.plans.search_plans import LINES, lines, table


def lookup_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as config items: user.type is the path, the type the key."""
    events = table(spark, sf_dir, "events")
    items = events.select(F.col("event_id").alias("item_id"), F.concat(F.lit("t."), "event_type").alias("config_key"), F.concat_ws(".", F.lit("user"), F.col("user_id").cast("string"), F.lit("t"), "event_type").alias("key_path"), F.concat(F.lit("pwd=s3cret;v"), F.col("event_id").cast("string")).alias("value_raw"), (F.col("user_id") % 10).alias("entity_id"))
    entities = events.select((F.col("user_id") % 10).alias("entity_id")).distinct().filter("entity_id <> 3").select("entity_id", F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("entity_key"), F.lit("group").alias("entity_type"))
    return lookups.configs(values(spark, "key string", [("t.signup",), ("user.7.",), ("none",)]), items, entities)


LOOKUP_CONFIG = """
WITH i AS (SELECT event_id AS item_id, 't.' || event_type AS config_key, 'user.' || user_id || '.t.' || event_type AS key_path, 'pwd=****;v' || event_id AS value, user_id % 10 AS eid FROM events)
SELECT k.key, CASE WHEN config_key = k.key THEN 'exact' ELSE 'path' END AS how, item_id, key_path, value, CASE WHEN eid <> 3 THEN 'e' || eid END AS entity_key
FROM (VALUES ('t.signup'), ('user.7.'), ('none')) k(key) JOIN i ON config_key = k.key OR (k.key <> 't.signup' AND contains(key_path, k.key))
"""


def trace_config_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_key"))
    bindings = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.lit("CLASS").alias("bind_type"), F.col("s_name").alias("bind_target"), F.lit("exact_match").alias("bind_strategy"), F.lit("token=1").alias("evidence"))
    return lookups.config_impact(values(spark, "entity_key string", [("NATION_3",), ("NATION_9",)]), entities, bindings)


TRACE_CONFIG_IMPACT = "SELECT n_name AS entity_key, 'CLASS' AS bind_type, s_name AS bind_target, 'exact_match' AS bind_strategy, 'token=1' AS evidence FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN ('NATION_3', 'NATION_9')"


def lookup_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rule_set_id"), F.col("r_name").alias("name"), F.lit("geo").alias("category"))
    bound = table(spark, sf_dir, "nation").filter("n_regionkey <> 1").select(F.col("n_regionkey").alias("rule_set_id"), F.lit("TABLE").alias("bind_type"), F.col("n_name").alias("bind_target"), F.lit("owner").alias("bind_role"))
    return lookups.rules(sets.select("name"), sets, bound)


LOOKUP_RULE = """
SELECT r_name AS name, r_regionkey AS rule_set_id, 'geo' AS category, coalesce(string_agg('TABLE:' || n_name || ':owner', ',' ORDER BY 'TABLE:' || n_name || ':owner'), '') AS bindings
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_regionkey <> 1 GROUP BY 1, 2
"""


def explain_rule_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = values(spark, "rule_set_id int, source_id string", [(1, "a"), (2, "b"), (3, "none")])
    clauses = values(spark, "rule_set_id int, clause string", [(1, "x"), (1, "y")])
    sources = values(spark, "source_id string, key_columns string, value_columns string", [("a", '["k","l"]', '["v","k"]'), ("b", "bad json", None)])
    return lookups.rule_logic(sets, clauses, sources)


EXPLAIN_RULE_LOGIC = "SELECT * FROM (VALUES (1, 2::BIGINT, 'k,l,v'), (2, 0, ''), (3, 0, '')) t(rule_set_id, n_clauses, sample_columns)"


def lookup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = values(spark, "table string, ordinal int, column string", [("Brand#2", 2, "b"), ("Brand#2", 1, "a"), ("ECONOMY", 1, "c")])
    return lookups.tables(values(spark, "table string", [("Brand#2",), ("ECONOMY",), ("UNKNOWN",)]), deduped_edges(spark, sf_dir), columns, values(spark, "table string, comment string", [("Brand#2", "a brand")]))


LOOKUP_TABLE = f"""
WITH {BRAND_EDGES}, w(t, columns, comment) AS (VALUES ('Brand#2', 'a,b', 'a brand'), ('ECONOMY', 'c', ''), ('UNKNOWN', '', ''))
SELECT t AS "table", (SELECT count(*) FROM ded WHERE src_table = t) AS edges_out, (SELECT count(*) FROM ded WHERE dst_table = t) AS edges_in, columns, comment FROM w
"""


def lookup_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = table(spark, sf_dir, "supplier").select(F.lit("SUP").alias("owner"), F.col("s_name").alias("name"), F.lit("VIEW").alias("type"), F.when(F.col("s_suppkey") % 2 == 0, "GEO").otherwise("OLD").alias("referenced_owner"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("referenced_name"))
    return lookups.dependents(values(spark, "owner string, name string", [("GEO", "NATION_3"), ("", "NATION_4")]), deps)


LOOKUP_DEPENDENCY = """
SELECT 'NATION_' || s_nationkey AS name, 'SUP' AS dependent_owner, s_name AS dependent, 'VIEW' AS type FROM supplier WHERE (s_nationkey = 3 AND s_suppkey % 2 = 0) OR s_nationkey = 4
"""


def lookup_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = values(spark, "template_id string, sql_text string", [("t2", "insert into a values (ord_seq.nextval)"), ("t1", "select ORD_SEQ.CURRVAL, x_seq.nextval from dual"), ("t3", "select 1")])
    return lookups.sequences(values(spark, "sequence string", [("ORD_SEQ",), ("Y_SEQ",)]), values(spark, "sequence string, last string", [("ORD_SEQ", "17")]), templates)


LOOKUP_SEQUENCE = "SELECT * FROM (VALUES ('ORD_SEQ', '17', 't1,t2'), ('Y_SEQ', NULL, '')) t(sequence, last, code_refs)"


def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "name string, container string, file string", [("OrderBatchJob", "p", "a"), ("OrderBatch", "p", "b"), ("orderbatchx", "p", "c"), ("Order", "p", "d"), ("OrderBatchJobRunner", "p", "e")])
    return lookups.code(rows, "OrderBatchJob")


SEARCH_CODE = "SELECT * FROM (VALUES ('OrderBatchJob', 'p', 'a', 0, 1.0::DOUBLE), ('OrderBatchJobRunner', 'p', 'e', 2, 0.6::DOUBLE), ('OrderBatch', 'p', 'b', 0, 0.6::DOUBLE), ('orderbatchx', 'p', 'c', 2, 0.6::DOUBLE)) t(name, container, file, match, name_match_strength)"


def read_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumnRenamed("doc_id", "file")
    methods = rows.groupBy("file").agg(F.max("lineno").alias("n")).filter("n >= 4").select(F.concat(F.lit("Doc"), F.col("file").cast("string"), F.lit(".m()")).alias("method_fqn"), "file", F.lit(2).alias("start_line"), F.col("n").alias("end_line"))
    found = lookups.symbol_source(methods.select("method_fqn"), methods, rows, 3)
    return found.select("method_fqn", F.length("source").alias("n_chars"), "truncated")


READ_SYMBOL = f"""
WITH {LINES}, m AS (SELECT doc_id, max(lineno) AS n FROM l GROUP BY doc_id HAVING max(lineno) >= 4)
SELECT 'Doc' || l.doc_id || '.m()' AS method_fqn, length(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY lineno), '(?i)(password|passwd|pwd|secret|credential)(\\s*)=\\s*[^\\s;]+', '\\1\\2=****', 'g'), '://[^/\\s@]+:[^/\\s@]+@', '://****@', 'g'))::INTEGER AS n_chars, max(m.n) - 1 > 3 AS truncated
FROM l JOIN m USING (doc_id) WHERE lineno BETWEEN 2 AND 4 GROUP BY l.doc_id
"""


def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "part"]
    counts = reduce(DataFrame.unionByName, [table(spark, sf_dir, n).agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n in names])
    return lookups.health(counts, [*names, "never_built"])


HEALTH_CHECK = """
SELECT 'region' AS "table", count(*) AS n, 'ready' AS state FROM region UNION ALL SELECT 'nation', count(*), 'ready' FROM nation UNION ALL SELECT 'part', count(*), 'ready' FROM part UNION ALL SELECT 'never_built', 0, 'not_built'
"""

_ALL = (lookup_config, trace_config_impact, lookup_rule, explain_rule_logic, lookup_table, lookup_dependency, lookup_sequence, search_code, read_symbol, health_check)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
