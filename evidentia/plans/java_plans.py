"""SQL in Java files made from part's columns in five forms, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import java_strings
from evidentia.plans.search_plans import table

#: By p_partkey % 5; %1$d is the key, %2$d the size, %3$s the brand.
FORMS = (
    'class D%1$d {\n  String a() {\n    String t = "tab_%2$d";\n    String s = "SELECT * FROM " + t\n      + " WHERE brand = " + b;\n    return s;\n  }\n}',
    'class D%1$d {\n  void a(boolean x) {\n    StringBuilder sb = new StringBuilder();\n    sb.append("DELETE FROM t_%2$d").append(tail);\n    if (x) { sb.append(" WHERE brand = \'%3$s\'"); }\n  }\n}',
    '// String s = "SELECT 1 FROM comment_%2$d";\nclass D%1$d {\n  String f = String.format("SELECT c%%d FROM %%s", %2$d, "t_%1$d"), r = "UPDATE @@ SET a = 1".replace("@@", "%3$s");\n}',
    'class D%1$d {\n  class In { void go() {\n    String q = "INSERT INTO t_" + n(%2$d, x) + (" VALUES " + v);\n    run(() -> { st.executeUpdate(q); });\n  } }\n  void b() { String c = "MERGE INTO " + m; c = "not of the language"; }\n}',
    'class D%1$d {\n  String plain = "%3$s";\n  void a() { String w = k ? "SELECT 1" : "SELECT 2"; this.z = "CREATE TABLE t_%2$d"; }\n}',
)


def java_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    form = F.col("p_partkey") % len(FORMS)
    text = F.coalesce(*[F.when(form == i, F.format_string(f, F.col("p_partkey").cast("long"), F.col("p_size").cast("int"), F.col("p_brand"))) for i, f in enumerate(FORMS)])
    return java_strings.sql_strings(parts.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".java")).alias("path"), text.alias("content")))


JAVA_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size AS z, p_brand AS b, p_partkey % 5 AS f FROM part), r AS (SELECT k, unnest(CASE f
  WHEN 0 THEN [['4', '5', '.a', 'SELECT * FROM tab_' || z || ' WHERE brand = ${?}', 'local_var', 'medium', 'false']]
  WHEN 1 THEN [['2', '6', '.a', 'DELETE FROM t_' || z || '${?} WHERE brand = ''' || b || '''', 'string_builder', 'low', 'true']]
  WHEN 2 THEN [['3', '3', '', 'SELECT c' || z || ' FROM t_' || k, 'literal', 'medium', 'false'], ['3', '3', '', 'UPDATE ' || b || ' SET a = 1', 'literal', 'medium', 'false']]
  WHEN 3 THEN [['3', '3', 'In.go', 'INSERT INTO t_${?} VALUES ${?}', 'concat', 'medium', 'false'], ['6', '6', '.b', 'MERGE INTO ${?}', 'concat', 'low', 'false']]
  ELSE [['3', '3', '.a', 'CREATE TABLE t_' || z, 'literal', 'low', 'false']] END) AS x FROM p)
SELECT k || '.java' AS path, x[1]::BIGINT AS line_start, x[2]::BIGINT AS line_end, CASE WHEN x[3] LIKE 'In%' THEN x[3] ELSE 'D' || k || x[3] END AS container,
  x[4] AS sql_text, x[5] AS recovery_mode, x[6] AS confidence, x[7] = 'true' AS branch_detected FROM r
"""

QUERIES = {"java_sql": java_sql}
ORACLE_SQL = {"java_sql": JAVA_SQL}
