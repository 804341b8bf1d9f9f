"""Queries over the scopes of statements, made from part's columns in eight forms, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import scopes
from evidentia.plans.search_plans import table

#: By p_partkey % 8; %1$d is the key, %2$d the size.
FORMS = (
    "SELECT o.id FROM ord_%2$d o, cust_%1$d c WHERE o.cust = c.id (+) AND extract(year FROM o.day) = 2000",
    "WITH RECURSIVE r AS (SELECT id FROM tree_%2$d UNION ALL SELECT t.id FROM tree_%2$d t JOIN r ON t.up = r.id) SELECT * FROM r JOIN leaf_%1$d l ON l.id = r.id",
    "SELECT a FROM main_%1$d m WHERE m.x IN (SELECT max(y) FROM t_%2$d GROUP BY z) AND EXISTS (SELECT 1 FROM mid WHERE mid.k IN (SELECT k FROM deep_%1$d))",
    "INSERT INTO upc.dst_%1$d (c1, c2) SELECT s.a, upper(s.b) || s.c FROM sec.src_%2$d s -- FROM nothing",
    "UPDATE stock_%1$d s SET n = (SELECT max(m.n) FROM moves_%2$d m WHERE m.id = s.id)",
    "MERGE INTO target_%1$d t USING (SELECT id, a FROM source_%2$d) s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.a = s.a",
    "INSERT INTO mart.sums_%1$d (a, b) WITH base AS (SELECT o.id AS oid, o.cust FROM sales.ord_%2$d o), two AS (SELECT oid, cust AS who FROM base) SELECT d.oid, c.name FROM (SELECT * FROM two) d JOIN cust_%1$d c ON d.who = c.id",
    "DELETE FROM old_%1$d WHERE id IN (SELECT id FROM old_%2$d.gone /* , FROM hidden */)",
)


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("template_id"), F.col("p_size").cast("int").alias("size"))
    key, form = F.col("template_id"), F.col("template_id") % len(FORMS)
    text = F.coalesce(*[F.when(form == i, F.format_string(f, key, F.col("size"))) for i, f in enumerate(FORMS)])
    return parts.select("template_id", text.alias("sql_text"))


def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.tables_read(_statements(spark, sf_dir))


def sql_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.relations(_statements(spark, sf_dir))


def sql_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.column_lineage(_statements(spark, sf_dir))


PARTS = "p AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 8 AS f FROM part)"
SQL_TABLES = f"""
WITH {PARTS}, t AS (SELECT k, z, unnest(CASE f
  WHEN 0 THEN [['', 'ORD_' || z], ['', 'CUST_' || k]] WHEN 1 THEN [['', 'TREE_' || z], ['', 'LEAF_' || k]] WHEN 2 THEN [['', 'MAIN_' || k], ['', 'T_' || z], ['', 'MID'], ['', 'DEEP_' || k]]
  WHEN 3 THEN [['UPC', 'DST_' || k], ['SEC', 'SRC_' || z]] WHEN 4 THEN [['', 'STOCK_' || k], ['', 'MOVES_' || z]] WHEN 5 THEN [['', 'TARGET_' || k], ['', 'SOURCE_' || z]]
  WHEN 6 THEN [['MART', 'SUMS_' || k], ['SALES', 'ORD_' || z], ['', 'CUST_' || k]] ELSE [['', 'OLD_' || k], ['OLD_' || z, 'GONE']] END) AS x FROM p)
SELECT k AS template_id, x[1] AS schema, x[2] AS "table" FROM t
"""
SQL_RELATIONS = f"""
WITH {PARTS}, r AS (SELECT k, unnest(CASE f
  WHEN 0 THEN [['', 'ORD_' || z, 'CUST', '', 'CUST_' || k, 'ID', 'WHERE_EQ']]
  WHEN 1 THEN [['', 'LEAF_' || k, 'ID', '', 'TREE_' || z, 'ID', 'JOIN']]
  WHEN 2 THEN [['', 'T_' || z, '', '', 'MAIN_' || k, '', 'SUBQUERY'], ['', 'MID', '', '', 'MAIN_' || k, '', 'EXISTS'], ['', 'DEEP_' || k, '', '', 'MAIN_' || k, '', 'EXISTS'], ['', 'DEEP_' || k, '', '', 'MAIN_' || k, '', 'SUBQUERY']]
  WHEN 3 THEN [['SEC', 'SRC_' || z, '', 'UPC', 'DST_' || k, '', 'INSERT_SELECT']]
  WHEN 4 THEN [['', 'MOVES_' || z, '', '', 'STOCK_' || k, '', 'UPDATE_FROM']]
  WHEN 5 THEN [['', 'SOURCE_' || z, '', '', 'TARGET_' || k, '', 'MERGE'], ['', 'TARGET_' || k, 'ID', '', 'SOURCE_' || z, 'ID', 'JOIN']]
  WHEN 6 THEN [['SALES', 'ORD_' || z, '', 'MART', 'SUMS_' || k, '', 'INSERT_SELECT'], ['', 'CUST_' || k, '', 'MART', 'SUMS_' || k, '', 'INSERT_SELECT'], ['SALES', 'ORD_' || z, 'CUST', '', 'CUST_' || k, 'ID', 'JOIN']]
  ELSE [['OLD_' || z, 'GONE', '', '', 'OLD_' || k, '', 'DELETE_FROM'], ['OLD_' || z, 'GONE', '', '', 'OLD_' || k, '', 'SUBQUERY']] END) AS x FROM p)
SELECT k AS template_id, x[1] AS src_schema, x[2] AS src_table, x[3] AS src_col, x[4] AS dst_schema, x[5] AS dst_table, x[6] AS dst_col, x[7] AS relation_type,
  CASE WHEN x[7] IN ('INSERT_SELECT', 'UPDATE_FROM', 'DELETE_FROM', 'MERGE') THEN 'DIRECT' ELSE 'INDIRECT' END AS lineage_type FROM r
"""
SQL_COLUMNS = f"""
WITH {PARTS}, r AS (SELECT k, unnest(CASE f
  WHEN 3 THEN [['SEC', 'SRC_' || z, 'A', 'UPC', 'DST_' || k, 'C1'], ['SEC', 'SRC_' || z, 'B', 'UPC', 'DST_' || k, 'C2'], ['SEC', 'SRC_' || z, 'C', 'UPC', 'DST_' || k, 'C2']]
  ELSE [['SALES', 'ORD_' || z, 'ID', 'MART', 'SUMS_' || k, 'A'], ['', 'CUST_' || k, 'NAME', 'MART', 'SUMS_' || k, 'B']] END) AS x FROM p WHERE f IN (3, 6))
SELECT k AS template_id, x[1] AS src_schema, x[2] AS src_table, x[3] AS src_col, x[4] AS dst_schema, x[5] AS dst_table, x[6] AS dst_col FROM r
"""

QUERIES = {f.__name__: f for f in (sql_tables, sql_relations, sql_columns)}
ORACLE_SQL = {"sql_tables": SQL_TABLES, "sql_relations": SQL_RELATIONS, "sql_columns": SQL_COLUMNS}
