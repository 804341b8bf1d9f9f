"""Graph, lineage and change queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import scores
from evidentia.operators import changes, config, graph, lineage
from evidentia.plans.search_plans import table
from evidentia.sources import dictionary


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier from order lines, supplier -> nation, nation -> region, as calls."""
    part = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("callee"), F.concat_ws("-", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("row_id")).distinct()
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("callee"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("row_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("caller"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("callee"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("row_id"))
    return part.unionByName(supplier).unionByName(nation)


CALL_EDGES = """
e AS (
  SELECT DISTINCT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee, lpad(l_partkey::VARCHAR, 9, '0') || '-' || lpad(l_suppkey::VARCHAR, 9, '0') AS row_id FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey FROM nation
)"""


def seeds(spark: SparkSession, nodes: list[str]) -> DataFrame:
    return values(spark, "root string, node string", [(n, n) for n in nodes])


def calls_2hop_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(call_edges(spark, sf_dir), seeds(spark, ["p1", "p2", "s3"]), 2, 200).select("root", "hop", "caller", "callee")


CALLS_2HOP_CALLEES = f"""
WITH {CALL_EDGES}, r(root) AS (VALUES ('p1'), ('p2'), ('s3')),
c AS MATERIALIZED (SELECT caller, callee FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY row_id) AS place FROM e) WHERE place <= 200),
h1 AS MATERIALIZED (SELECT root, 1 AS hop, caller, callee FROM r JOIN c ON c.caller = root),
h2 AS (SELECT root, 2 AS hop, c.caller, c.callee FROM (SELECT DISTINCT root, callee AS node FROM h1 WHERE callee <> root) f JOIN c ON c.caller = f.node)
SELECT * FROM h1 UNION ALL SELECT * FROM h2
"""


def calls_2hop_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expand(call_edges(spark, sf_dir), seeds(spark, ["r0", "n5"]), 2, 200, reverse=True).select("root", "hop", "caller", "callee")


CALLS_2HOP_CALLERS = f"""
WITH {CALL_EDGES}, c AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY row_id) AS place FROM e QUALIFY place <= 200), r(root) AS (VALUES ('r0'), ('n5')),
h1 AS (SELECT root, 1 AS hop, caller, callee FROM r JOIN c ON c.callee = root),
h2 AS (SELECT root, 2 AS hop, c.caller, c.callee FROM (SELECT DISTINCT root, caller AS node FROM h1) f JOIN c ON c.callee = f.node)
SELECT * FROM h1 UNION ALL SELECT * FROM h2
"""


def calls_truncation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.expand(call_edges(spark, sf_dir), seeds(spark, ["p1", "p7", "n5"]), 1, 5, reverse=False).unionByName(graph.expand(call_edges(spark, sf_dir), seeds(spark, ["n5", "s1"]), 1, 5, reverse=True))
    return found.select("root", "caller", "callee", "truncated")


CALLS_TRUNCATION_FLAGS = f"""
WITH {CALL_EDGES}, d AS (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY row_id) AS place, count(*) OVER (PARTITION BY caller) AS n FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY row_id) AS place, count(*) OVER (PARTITION BY callee) AS n FROM e)
SELECT caller AS root, caller, callee, n > 5 AS truncated FROM d WHERE place <= 5 AND caller IN ('p1', 'p7', 'n5')
UNION ALL SELECT callee AS root, caller, callee, n > 5 AS truncated FROM u WHERE place <= 5 AND callee IN ('n5', 's1')
"""


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand -> type edges from order lines: the return flag as relation, the line status as confidence."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    relation = F.when(F.col("l_returnflag") == "A", "JOIN").when(F.col("l_returnflag") == "N", "WRITE").otherwise("INSERT_SELECT")
    confidence = F.when(F.col("l_linestatus") == "F", "low").otherwise("medium")
    rows = lines.join(parts, "l_partkey").select(F.col("p_brand").alias("src_table"), F.col("p_type").alias("dst_table"), relation.alias("relation_type"), confidence.alias("confidence"), F.lit(1).alias("evidence_count"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"), (F.col("l_orderkey") % 7).alias("o"))
    return rows.withColumn("edge_id", lineage.edge_id(F.col("src_table"), F.col("dst_table"), F.col("relation_type")))


BRAND_EDGES = """
b AS (
  SELECT p_brand AS src_table, p_type AS dst_table, CASE l_returnflag WHEN 'A' THEN 'JOIN' WHEN 'N' THEN 'WRITE' ELSE 'INSERT_SELECT' END AS relation_type,
    CASE WHEN l_linestatus = 'F' THEN 'low' ELSE 'medium' END AS confidence, l_orderkey * 100 + l_linenumber AS row_id, l_orderkey % 7 AS o
  FROM lineitem JOIN part ON p_partkey = l_partkey
), be AS (
  SELECT *, 'E' || upper(substr(md5(CASE WHEN relation_type IN ('JOIN', 'WHERE_EQ') THEN least(src_table, dst_table) || ':' || greatest(src_table, dst_table) ELSE src_table || ':' || dst_table END || ':' || relation_type), 1, 12)) AS edge_id FROM b
), bd AS (
  SELECT edge_id, min(src_table) AS src_table, min(dst_table) AS dst_table, min(relation_type) AS relation_type, max(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 END) AS rank,
    count(*) AS given, count(*) FILTER (o = 0) AS counted FROM be GROUP BY edge_id
), ded AS (
  SELECT edge_id, src_table, dst_table, relation_type, CASE rank WHEN 1 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN counted > 0 THEN counted ELSE given END::BIGINT AS evidence_count FROM bd
)"""


def deduped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = brand_edges(spark, sf_dir)
    return lineage.deduplicated(edges, edges.filter("o = 0").select("edge_id"))


def lineage_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped_edges(spark, sf_dir)


LINEAGE_EDGE_DEDUP = f"WITH {BRAND_EDGES} SELECT * FROM ded"


def lineage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = values(spark, "name string", [("Brand#1",), ("Brand#2",), ("Brand#3",), ("ECONOMY",), ("STANDARD",)])
    fks = values(spark, "a string, b string", [("Brand#2", "ECONOMY"), ("PROMO", "Brand#3")])
    return lineage.validated(deduped_edges(spark, sf_dir), known, fks)


LINEAGE_VALIDATE = f"""
WITH {BRAND_EDGES}, k(name) AS (VALUES ('Brand#1'), ('Brand#2'), ('Brand#3'), ('ECONOMY'), ('STANDARD')),
m AS (SELECT *, src_table IN (SELECT name FROM k) AS sk, dst_table IN (SELECT name FROM k) AS dk FROM ded)
SELECT edge_id, src_table, dst_table, relation_type, CASE
  WHEN (src_table, dst_table) IN (('Brand#2', 'ECONOMY'), ('Brand#3', 'PROMO')) THEN 'high' WHEN NOT (sk AND dk) THEN 'low' ELSE confidence END AS confidence
FROM m WHERE sk OR dk
"""


def lineage_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = deduped_edges(spark, sf_dir)
    down = lineage.neighbours(edges, "Brand#2", True).withColumn("direction", F.lit("down"))
    return down.unionByName(lineage.neighbours(edges, "ECONOMY", False).withColumn("direction", F.lit("up")))


LINEAGE_UP_DOWN = f"""
WITH {BRAND_EDGES}
SELECT dst_table AS "table", arg_min(relation_type, edge_id) AS relation_type, count(*) AS n_edges, 'down' AS direction FROM ded WHERE src_table = 'Brand#2' GROUP BY dst_table
UNION ALL SELECT src_table, arg_min(relation_type, edge_id), count(*), 'up' FROM ded WHERE dst_table = 'ECONOMY' GROUP BY src_table
"""


def table_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.degree(deduped_edges(spark, sf_dir))


TABLE_EDGE_COUNTS = f"""
WITH {BRAND_EDGES}, s AS (SELECT src_table AS t, 1 AS o, 0 AS i FROM ded UNION ALL SELECT dst_table, 0, 1 FROM ded)
SELECT t AS "table", sum(o)::BIGINT AS edges_out, sum(i)::BIGINT AS edges_in FROM s GROUP BY t
"""


def object_dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.lit("GEO").alias("owner"), F.col("n_name").alias("name"), F.lit("GEO").alias("referenced_owner"), F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("referenced_name"), F.when(F.col("n_nationkey") % 5 == 0, "SEQUENCE").otherwise("TABLE").alias("referenced_type"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit("SUP").alias("owner"), F.col("s_name").alias("name"), F.lit("GEO").alias("referenced_owner"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("referenced_name"), F.lit("VIEW").alias("referenced_type"))
    return lineage.object_edges(nation.unionByName(supplier))


OBJECT_DEPENDENCY_EDGES = """
SELECT DISTINCT src, dst, 'OBJECT_DEPENDENCY' AS edge_kind, 'DIRECT' AS lineage_type FROM (
  SELECT 'GEO.REGION_' || n_regionkey AS src, 'GEO.' || n_name AS dst FROM nation WHERE n_nationkey % 5 <> 0
  UNION ALL SELECT 'GEO.NATION_' || s_nationkey, 'SUP.' || s_name FROM supplier)
"""


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("cust_"), (F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "_202401").when(F.col("c_custkey") % 3 == 1, "@link").otherwise("")).alias("raw")).distinct()
    synonyms = values(spark, "synonym string, target string", [("cust", "CUSTOMER")])
    metadata = values(spark, "owner string, table string", [("A", "CUSTOMER"), ("A", "CUST_100"), ("B", "CUST_100")])
    return lineage.resolved_names(names, synonyms, metadata)


NAME_RESOLUTION = """
WITH n AS (SELECT DISTINCT 'cust_' || (c_custkey % 50) || CASE c_custkey % 3 WHEN 0 THEN '_202401' WHEN 1 THEN '@link' ELSE '' END AS raw FROM customer),
b AS (SELECT raw, regexp_replace(regexp_replace(upper(split_part(raw, '@', 1)), '_[0-9]{1,2}$', ''), '_[0-9]{6}$', '') AS base FROM n)
SELECT raw, CASE WHEN base = 'CUST' THEN 'A' ELSE '' END AS owner, CASE WHEN base = 'CUST' THEN 'CUSTOMER' ELSE base END AS "table" FROM b
"""


def fk_unresolved_dblinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = values(spark, "link string, host string, service string", [("L1.WORLD", "h1", "s1"), ("L2", "h2", "s2"), ("L3.X", "h3", "s3"), ("L4", "h4", "s4")])
    instances = values(spark, "host string, service string, instance string", [("h2", "s2", "db2"), ("h1", "s1", "db1")])
    overrides = values(spark, "name string, instance string", [("L1.WORLD", "over1"), ("L3", "over3")])
    return lineage.table_of_link(links, instances, overrides)


FK_UNRESOLVED_DBLINKS = "SELECT * FROM (VALUES ('L1.WORLD', 'over1'), ('L2', 'db2'), ('L3.X', 'over3'), ('L4', '')) t(link, instance)"


def dataflow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = deduped_edges(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    brand = F.concat(F.lit("Brand#"), (F.col("doc_id") % 20 + 1).cast("string"))
    linked = docs.select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("evidence_ref"), brand.alias("src_table"))
    evidence = linked.join(edges.select("src_table", "edge_id"), "src_table").select("evidence_ref", "edge_id")
    templates = docs.select(F.col("source").alias("container"), F.when(F.col("doc_id") % 2 == 0, "PROMO").otherwise(F.concat(F.lit("T_"), F.col("lang"))).alias("table")).distinct()
    return lineage.dataflow(edges, evidence, templates)


DATAFLOW_TRACE = f"""
WITH {BRAND_EDGES}, ev AS (SELECT source AS container, 'Brand#' || (doc_id % 20 + 1) AS src_table FROM documents),
a AS (SELECT container, dst_table AS tab, relation_type, 'evidence' AS source, 0 AS way FROM ev JOIN ded USING (src_table)
  UNION ALL SELECT DISTINCT source, CASE WHEN doc_id % 2 = 0 THEN 'PROMO' ELSE 'T_' || lang END, 'TEMPLATE', 'template', 1 FROM documents)
SELECT container, tab AS "table", relation_type, source FROM a QUALIFY row_number() OVER (PARTITION BY container, tab ORDER BY way, relation_type) = 1
"""

SQL_CORPUS = [
    ("t1", "INSERT INTO pm_offer_cha SELECT * FROM pm_offer_base"),
    ("t2", "SELECT a.id FROM orders a JOIN items b ON a.id = b.order_id WHERE a.x = 1"),
    ("t3", "SELECT * FROM orders o, customers c WHERE o.cust_id = c.id(+)"),
    ("t4", "UPDATE stock SET n = (SELECT max(n) FROM moves)"),
    ("t5", "MERGE INTO target t USING source s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.a = s.a"),
    ("t6", "SELECT seq.NEXTVAL FROM dual"),
    ("t7", "CREATE TABLE copy_${month} AS SELECT * FROM ledger@link"),
]


def lineage_edges_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineage.equal_pairs(values(spark, "template_id string, sql_text string", SQL_CORPUS))
    return found.withColumn("edge_id", lineage.edge_id(F.col("src_table"), F.col("dst_table"), F.col("relation_type")))


LINEAGE_EDGES_BUILD = """
WITH r(template_id, src_table, dst_table, relation_type) AS (VALUES
  ('t1', 'PM_OFFER_BASE', 'PM_OFFER_CHA', 'INSERT_SELECT'), ('t2', 'ITEMS', 'ORDERS', 'JOIN'), ('t3', 'CUSTOMERS', 'ORDERS', 'WHERE_EQ'),
  ('t4', 'MOVES', 'STOCK', 'UPDATE'), ('t5', 'SOURCE', 'TARGET', 'MERGE'), ('t7', 'LEDGER', 'COPY_PH', 'INSERT_SELECT'))
SELECT *, 'E' || upper(substr(md5(src_table || ':' || dst_table || ':' || relation_type), 1, 12)) AS edge_id FROM r
"""


def fk_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("FK_"), "n_name").alias("name"), F.col("n_name").alias("table"), F.lit("R").alias("type"), F.concat(F.lit("PK_"), F.col("n_regionkey").cast("string")).alias("r_name"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("PK_"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("table"), F.lit("P").alias("type"), F.lit(None).cast("string").alias("r_name"))
    return lineage.foreign_keys(nation.unionByName(region))


FK_SELF_JOIN = "SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey"


def column_comment_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = values(spark, "owner string, table string, column string", [("D", "PART", "p_name"), ("D", "PART", "p_size"), ("D", "ORDERS", "o_custkey")])
    comments = values(spark, "owner string, table string, column string, comment string", [("D", "PART", "p_name", "the name"), ("X", "PART", "p_size", "other owner")])
    return columns.join(comments, ["owner", "table", "column"], "left").select("owner", "table", "column", F.coalesce("comment", F.lit("")).alias("comment"))


COLUMN_COMMENT_LEFT_JOIN = """SELECT * FROM (VALUES ('D', 'PART', 'p_name', 'the name'), ('D', 'PART', 'p_size', ''), ('D', 'ORDERS', 'o_custkey', '')) t(owner, "table", "column", comment)"""


def index_column_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    ordered = F.array_sort(F.collect_list(F.struct("p_size", "p_partkey")))
    return parts.groupBy("p_brand", "p_type").agg(F.array_join(F.transform(ordered, lambda x: x["p_partkey"].cast("string")), ",").alias("columns"))


INDEX_COLUMN_LISTAGG = "SELECT p_brand, p_type, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size, p_partkey) AS columns FROM part GROUP BY p_brand, p_type"


def sequence_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max("o_custkey").alias("last"), F.lit(0).alias("low"), F.max("o_orderkey").alias("high"))
    usage = scores.sequence_usage(F.col("last"), F.col("low"), F.col("high"))
    return keys.select("o_orderstatus", usage.alias("usage"), F.coalesce(usage > 80, F.lit(False)).alias("alert"))


SEQUENCE_CAPACITY = """
WITH k AS (SELECT o_orderstatus, max(o_custkey) AS last, max(o_orderkey) AS high FROM orders GROUP BY 1)
SELECT o_orderstatus, round((last * 100)::DOUBLE / high, 2) AS usage, coalesce(round((last * 100)::DOUBLE / high, 2) > 80, FALSE) AS alert FROM k
"""


def doc_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    current = docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest"))
    before = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("digest"))
    return current, before


def materialize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changes(*doc_states(spark, sf_dir))


MATERIALIZE_PLAN = """
SELECT doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 9 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'same' END AS change
FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 11 <> 0
"""


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.plan(materialize_plan(spark, sf_dir), True, True, 500)


INCREMENTAL_PLAN = f"""
WITH c AS ({MATERIALIZE_PLAN}), n AS (SELECT count(*) FILTER (change <> 'same') AS n_changed FROM c)
SELECT CASE WHEN n_changed = 0 THEN 'noop' WHEN n_changed > 500 THEN 'full' ELSE 'incremental' END AS mode, n_changed FROM n
"""


def incremental_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.element_at(F.split("text", " "), 1).alias("first"), F.try_element_at(F.split("text", " "), F.lit(2)).alias("second"))
    changed = docs.filter("file % 50 = 0").select("file")
    return graph.referrers(changed, docs.select("file", F.col("first").alias("name")), docs.select("file", F.col("second").alias("name")))


INCREMENTAL_EXPAND = """
WITH d AS (SELECT doc_id AS file, string_split(text, ' ')[1] AS first, string_split(text, ' ')[2] AS second FROM documents)
SELECT file, 'changed' AS reason FROM d WHERE file % 50 = 0
UNION ALL SELECT DISTINCT file, 'refers' FROM d WHERE file % 50 <> 0 AND second IN (SELECT first FROM d WHERE file % 50 = 0)
"""


def fan_out_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seen by each region's instance and by a mirror; the first instance that has one wins."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("instance"))
    live = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("s_suppkey", "instance")
    mirror = live.filter("s_suppkey % 4 = 0").withColumn("instance", F.lit(9))
    return config.first_wins(live.unionByName(mirror), ["s_suppkey"], ["instance"])


FAN_OUT_UNION = "SELECT s_suppkey, n_regionkey AS instance FROM supplier JOIN nation ON n_nationkey = s_nationkey"


def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as dictionary rows: a nation is an owner, its region the instance. Owner 05 fails, 24 has no instance, and
    owners of over the mean number of rows are cut where they are read by themselves."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("O%02d", "n_nationkey").alias("owner"), F.concat(F.lit("TEST_"), "n_regionkey").alias("instance"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    rows = customer.join(nation, "n_nationkey").select("owner", "instance", F.col("c_custkey").alias("id"))
    routes = [(r["owner"], None if r["owner"] == "O24" else r["instance"]) for r in nation.collect()]
    instances = sorted({i for _, i in routes if i})
    dump = dictionary.dump_reader({i: rows.filter(F.col("instance") == i).drop("instance") for i in instances}, "owner", ["owner", "id"])

    def read(instance: str, owners: list[str], most: int) -> DataFrame:
        if "O05" in owners:
            raise PySparkException(message="no privilege")
        return dump(instance, owners, most)

    found = dictionary.scan(spark, read, routes, instances, owner_col="owner", group=2, cap=max(1, customer.count() // 25))
    sums = found.rows.groupBy("owner").agg(F.sum("id").alias("size"))
    return found.report.join(sums, "owner", "left").select("owner", "instance", "n_rows", "status", F.coalesce("size", F.lit(0)).alias("size"))


DICTIONARY_SCAN = """
WITH cap AS (SELECT greatest(1, count(*) // 25) AS cap FROM customer),
o AS (SELECT n_nationkey, printf('O%02d', n_nationkey) AS owner, CASE WHEN n_nationkey <> 24 THEN 'TEST_' || n_regionkey END AS instance FROM nation),
k AS (SELECT n_nationkey, owner, instance, count(c_custkey) AS n FROM o LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, owner, instance),
c AS (SELECT *, (row_number() OVER (PARTITION BY instance ORDER BY owner) - 1) // 2 AS g FROM k),
s AS (SELECT *, sum(n) OVER w > cap * count(*) OVER w OR bool_or(n_nationkey = 5) OVER w AS alone FROM c, cap WINDOW w AS (PARTITION BY instance, g)),
t AS (SELECT *, CASE WHEN instance IS NULL OR n_nationkey = 5 THEN 'failed' WHEN n = 0 THEN 'empty' WHEN alone AND n > cap THEN 'truncated' ELSE 'ok' END AS status FROM s),
r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT owner, instance, CASE status WHEN 'failed' THEN 0 WHEN 'truncated' THEN any_value(cap) ELSE any_value(n) END::BIGINT AS n_rows, status, coalesce(sum(c_custkey) FILTER (status = 'ok' OR (status = 'truncated' AND k <= cap)), 0)::BIGINT AS size
FROM t LEFT JOIN r ON c_nationkey = n_nationkey GROUP BY owner, instance, status
"""


QUERIES = {
    f.__name__: f
    for f in (
        calls_2hop_callees, calls_2hop_callers, calls_truncation_flags, lineage_edge_dedup, lineage_validate, lineage_up_down, table_edge_counts, object_dependency_edges, name_resolution,
        fk_unresolved_dblinks, dataflow_trace, lineage_edges_build, fk_self_join, column_comment_left_join, index_column_listagg, sequence_capacity, materialize_plan, incremental_plan,
        incremental_expand, fan_out_union, dictionary_scan,
    )
}
ORACLE_SQL = {
    "calls_2hop_callees": CALLS_2HOP_CALLEES, "calls_2hop_callers": CALLS_2HOP_CALLERS, "calls_truncation_flags": CALLS_TRUNCATION_FLAGS, "lineage_edge_dedup": LINEAGE_EDGE_DEDUP,
    "lineage_validate": LINEAGE_VALIDATE, "lineage_up_down": LINEAGE_UP_DOWN, "table_edge_counts": TABLE_EDGE_COUNTS, "object_dependency_edges": OBJECT_DEPENDENCY_EDGES,
    "name_resolution": NAME_RESOLUTION, "fk_unresolved_dblinks": FK_UNRESOLVED_DBLINKS, "dataflow_trace": DATAFLOW_TRACE, "lineage_edges_build": LINEAGE_EDGES_BUILD, "fk_self_join": FK_SELF_JOIN,
    "column_comment_left_join": COLUMN_COMMENT_LEFT_JOIN, "index_column_listagg": INDEX_COLUMN_LISTAGG, "sequence_capacity": SEQUENCE_CAPACITY, "materialize_plan": MATERIALIZE_PLAN,
    "incremental_plan": INCREMENTAL_PLAN, "incremental_expand": INCREMENTAL_EXPAND, "fan_out_union": FAN_OUT_UNION, "dictionary_scan": DICTIONARY_SCAN,
}
