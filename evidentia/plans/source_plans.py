"""Source, requirement and streaming queries over files and texts that are made from the test tables' columns, and some on
literal inputs, for branches that the tables do not reach."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import mask, scores, text
from evidentia.operators import requirements
from evidentia.plans.lineage_plans import values
from evidentia.plans.search_plans import table
from evidentia.sources import files
from evidentia.streaming import watcher


def made(spark: SparkSession, sf_dir: str, path: str, content: str) -> DataFrame:
    """A file for each part: its path and content are SQL expressions over the part's columns and k, its number."""
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).select(F.expr(path).alias("path"), F.expr(content).alias("content"))


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written to the shared folder and read back."""
    place = f"{scratch(spark)}/sources-{spark.sql('select uuid()').first()[0]}"
    rows = made(spark, sf_dir, "concat(case k % 4 when 0 then 'dao' when 1 then 'web' when 2 then 'target' else 'doc' end, '/', case k % 3 when 0 then 'sql' when 1 then 'java' else 'md' end)", "concat(p_name, '\n', k)")
    rows.select(F.col("content").alias("value"), F.split("path", "/")[0].alias("folder"), F.split("path", "/")[1].alias("kind")).write.partitionBy("folder", "kind").text(place)
    found = files.read_files(spark, place, "*.txt")
    named = F.concat_ws("/", F.regexp_extract("path", "folder=([a-z]+)", 1), F.concat(F.lit("f."), F.regexp_extract("path", "kind=([a-z]+)", 1)))
    texts = found.select(named.alias("path"), F.size(F.split(F.rtrim(F.regexp_replace("content", r"\n$", "")), "\n")).alias("lines")).groupBy("path").agg(F.sum("lines").cast("long").alias("lines"))
    return files.scanned(texts, ["sql", "java"], ["target"]).select("path", "language", "module", "category", "lines")


SOURCE_SCAN = """
WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'dao' WHEN 1 THEN 'web' WHEN 2 THEN 'target' ELSE 'doc' END AS module, CASE p_partkey % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'java' ELSE 'md' END AS language FROM part)
SELECT module || '/f.' || language AS path, language, module, CASE WHEN module = 'dao' AND language = 'sql' THEN 'dao_sql' ELSE 'other_sql' END AS category, 2 * count(*) AS lines FROM f WHERE module <> 'target' AND language <> 'md' GROUP BY module, language
"""


def properties_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.properties_items(made(spark, sf_dir, "concat(k, '.properties')", r"concat('# note\n! note = 1\na.size = ', p_size, '\nlong.key: ', p_name, ' \\\n   and more\nflag=', k % 2 = 0, '\nplain\n')"))


PROPERTIES_ITEMS = """
SELECT p_partkey || '.properties' AS path, unnest(['a.size', 'long.key', 'flag']) AS key_path, unnest([p_size::VARCHAR, p_name || ' and more', CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END]) AS value, unnest(['int', 'string', 'bool']) AS value_type FROM part
"""


def tree_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    yaml_text = r"concat('a:\n  b: [', p_size, ', x', k, ']\n  c: true\n')"
    json_text = """concat('{"k": {"l": ', p_size, '.5}, "n": null, "name": "', p_name, '"}')"""
    return files.tree_items(made(spark, sf_dir, "concat(k, case k % 3 when 0 then '.yml' when 1 then '.json' else '-bad.yml' end)", f"case k % 3 when 0 then {yaml_text} when 1 then {json_text} else 'a: [1' end"))


TREE_ITEMS = """
SELECT p_partkey || '.yml' AS path, unnest(['a.b[0]', 'a.b[1]', 'a.c']) AS key_path, unnest([p_size::VARCHAR, 'x' || p_partkey, 'true']) AS value, unnest(['int', 'string', 'bool']) AS value_type FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey || '.json', unnest(['k.l', 'n', 'name']), unnest([p_size || '.5', '', p_name]), 'string' FROM part WHERE p_partkey % 3 = 1
"""


def spring_beans(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = """concat('<beans><bean id="b', k, '" class="x.', p_type, '"><property name="size" value="', p_size, '"/><property name="n" value="', p_name, '"/></bean><bean id="e', k, '" class="x.E"/></beans>')"""
    return files.spring_beans(made(spark, sf_dir, "concat(k, '.xml')", xml)).select("bean", "class", F.coalesce("property", F.lit("")).alias("property"), F.coalesce("value", F.lit("")).alias("value"))


SPRING_BEANS = """
SELECT 'b' || p_partkey AS bean, 'x.' || p_type AS "class", unnest(['size', 'n']) AS property, unnest([p_size::VARCHAR, p_name]) AS value FROM part UNION ALL SELECT 'e' || p_partkey, 'x.E', '', '' FROM part
"""


def mapper_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = """concat('<mapper namespace="m.P', k, '"><select id="one" resultType="u">SELECT * FROM t_', p_size, ' <where>id = #{id}</where></select><update id="up">UPDATE t_', p_size, '\n SET n = 1</update></mapper>')"""
    rows = made(spark, sf_dir, "concat(case when k % 4 = 0 then 'm-bak/' else 'm/' end, k, '.xml')", f"case when k % 5 = 0 then '<beans/>' else {xml} end")
    return files.mapper_statements(files.mapper_files(rows)).select("statement", "verb", "sql")


MAPPER_STATEMENTS = """
SELECT 'm.P' || p_partkey || unnest(['.one', '.up']) AS statement, unnest(['select', 'update']) AS verb, unnest(['SELECT * FROM t_' || p_size || ' id = #{id}', 'UPDATE t_' || p_size || ' SET n = 1']) AS sql FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0
"""


def mapper_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments five deep, over files, in a circle, unknown, and of one name in two files."""
    xml = """concat('<mapper namespace="m.P', k, '"><sql id="cols">c_', p_size, ' <include refid="m.P', k + 1, '.rest"/></sql><sql id="rest">r_', k, ' <include refid="deep"/></sql><sql id="deep">d <include refid="turn"/></sql>',
      '<sql id="turn">u_', k, ' <include refid="rest"/></sql><select id="one">SELECT <include refid="cols"></include>, <include refid="nowhere"/> FROM <choose><when test="a > 1">t_', p_size, '</when><otherwise>o_', k, '</otherwise></choose></select></mapper>')"""
    rows = made(spark, sf_dir, "concat(lpad(k, 9, '0'), '.xml')", xml)
    return files.mapper_statements(rows).select("statement", "sql", F.array_join("branches", "|").alias("branches"))


MAPPER_CLOSURE = """
WITH p AS (SELECT p_partkey AS k, p_size AS z, max(p_partkey) OVER () AS most FROM part),
t AS (SELECT k, z, 'SELECT c_' || z || CASE WHEN k < most THEN ' r_' || (k + 1) || ' d u_' || k || ' r_' || k ELSE '' END || ' , FROM' AS head FROM p)
SELECT 'm.P' || k || '.one' AS statement, head || ' t_' || z || ' o_' || k AS sql, head || '|t_' || z || '|o_' || k AS branches FROM t
"""


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = r"concat('CREATE TABLE own.a', k, ' (\n id NUMBER(10,2),\n name VARCHAR2(', p_size, ') not null,\n PRIMARY KEY (id)\n);\ncreate table b', k, ' (x date);')"
    return files.ddl_columns(made(spark, sf_dir, "concat(k, '.sql')", ddl)).select("table", "column", "type")


DDL_COLUMNS = """SELECT unnest(['A' || p_partkey, 'A' || p_partkey, 'B' || p_partkey]) AS "table", unnest(['ID', 'NAME', 'X']) AS "column", unnest(['NUMBER(10,2)', 'VARCHAR2(' || p_size || ')', 'DATE']) AS type FROM part"""


def tns_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tns = r"concat('Db', k, ' =\n (DESCRIPTION = (ADDRESS = (PROTOCOL = TCP)(HOST = Host', p_size, ')(PORT = ', 1500 + k % 50, ')) (CONNECT_DATA = (', case when k % 2 = 0 then 'SERVICE_NAME' else 'SID' end, ' = Svc', k, ')))\n')"
    return files.tns_aliases(made(spark, sf_dir, "'tnsnames.ora'", tns)).withColumn("easy", files.easy_connect(F.concat("host", F.lit(":"), "port", F.lit("/"), "service"))["port"])


TNS_ALIASES = "SELECT 'DB' || p_partkey AS alias, 'host' || p_size AS host, (1500 + p_partkey % 50)::INTEGER AS port, 'svc' || p_partkey AS service, (1500 + p_partkey % 50)::INTEGER AS easy FROM part"


def jsonl_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("case when p_partkey % 7 = 0 then '' else concat('a.B', p_size, '#m', p_partkey % 3, '()') end methodFqn", "concat('B', p_size, '.java') sourceFile", "p_size - 1 startLine", "p_size + 4 endLine")
    return files.jsonl_methods(rows)


JSONL_METHODS = "SELECT DISTINCT 'a.B' || p_size || '.m' || (p_partkey % 3) || '()' AS method_fqn, 'B' || p_size || '.java' AS source_file, greatest(p_size - 2, 0)::INTEGER AS start_line, (p_size + 3)::INTEGER AS end_line FROM part WHERE p_partkey % 7 > 0"


def readonly_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["SELECT * FROM t{k}", "select {k}; drop table x", "/* delete */ WITH a AS (SELECT {k}) SELECT * FROM a;", "DELETE FROM t{k}", "SELECT {k} FROM x -- update\n", "WITH a AS (SELECT {k}) INSERT INTO t SELECT * FROM a", "WITH x AS (SELECT {k}) EXEC p", "SELECT LISTAGG(n{k}, ',' ON OVERFLOW TRUNCATE) FROM t", "WITH x AS (SELECT {k}) TRUNCATE  TABLE t", "SELECT begin_date_{k} FROM t", "SELECT 1 FROM t{k} BEGIN"]
    sql = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{k}"), F.col("p_partkey").cast("string")) for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", files.readonly(sql).alias("allowed"))


READONLY_GATE = "SELECT p_partkey, p_partkey % 11 IN (0, 2, 4, 7, 9) AS allowed FROM part"


def email_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, body string", [(1, "Please add a field.\nBest regards\nAnn\n"), (2, "New rule.\nOn Monday Bob wrote:\n> old"), (3, "Thanks\n1. a long requirement line follows here")])
    return rows.select("id", requirements.email_body(F.col("body")).alias("body"))


EMAIL_BODY = "SELECT * FROM (VALUES (1, 'Please add a field.'), (2, 'New rule.'), (3, 'Thanks' || chr(10) || '1. a long requirement line follows here')) t(id, body)"

NUMBERED = "intro\n1. first\n  A, sub a\n  B: sub b\n    I, one\n    II. two\n  C sub c\n2、second\n10 Jan 2026 is text\n4) fourth\n   a, x\n"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.segments(values(spark, "doc_id long, text string", [(1, NUMBERED)]))
    return found.select("row", F.coalesce("parent", F.lit(-1)).alias("parent"), "level", "label", "style", "content", F.array_join("path", ">").alias("path"), "confidence")


SEGMENTS = """
SELECT * FROM (VALUES (0, -1, 0, '', 'none', 'intro', '', 'high'), (1, 0, 1, '1', 'arabic', '', '', 'high'), (2, 1, 2, 'A', 'letter_upper', '', '1. first', 'high'), (3, 1, 2, 'B', 'letter_upper', '', '1. first', 'high'),
  (4, 3, 3, 'I', 'roman_upper', '', '1. first>B: sub b', 'high'), (5, 3, 3, 'II', 'roman_upper', '', '1. first>B: sub b', 'high'), (6, 1, 2, 'C', 'letter_upper', '', '1. first', 'high'),
  (7, 0, 1, '2', 'arabic', '10 Jan 2026 is text', '', 'high'), (8, 0, 1, '4', 'arabic', '', '', 'high'), (9, 8, 2, 'a', 'letter_lower', '', '4) fourth', 'high')) t("row", parent, level, label, style, content, path, confidence)
"""


def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.segments(values(spark, "doc_id long, text string", [(1, NUMBERED)]))
    return requirements.grouped(found, 800).select("group", "context", "n_segments")


SEGMENT_GROUPS = """
SELECT * FROM (VALUES (0, '', 2), (1, '1. first', 2), (2, '1. first > B: sub b', 2), (3, '1. first', 1), (4, '', 2), (5, '4) fourth', 1)) t("group", context, n_segments)
"""


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string("password=secret%04d x=%d s=\"pin=%04d\" t='a.pwd: \"q%05d\"' primary_key=%d url=u?v=token=abc%03d;z secret_key=1", "c_custkey", "c_nationkey", F.col("c_custkey") % 1000, "c_custkey", "c_custkey", F.col("c_custkey") % 1000)
    return table(spark, sf_dir, "customer").select("c_custkey", mask.sanitized_text(body).alias("clean"))


SANITIZE_TEXT = r"""
SELECT c_custkey, 'password=****' || right(printf('%04d', c_custkey), 4) || ' x=' || c_nationkey || ' s="pin=****" t=''a.pwd=****' || right(printf('%05d', c_custkey), 4) || chr(39) || ' primary_key=' || c_custkey || ' url=u?v=token=****' || right(printf('abc%03d', c_custkey % 1000), 4) || ';z secret_key=****' AS clean FROM customer
"""


def redact_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string("use scott/tiger%d@db1 http://u:p%d@host/x jdbc:oracle:thin:@host:1521 key sk-proj-abcd%06d, gho_%022d pwd = abc%d;x", "c_custkey", "c_custkey", "c_custkey", "c_custkey", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", mask.redacted(body).alias("clean"), mask.is_sensitive_value(F.when(F.col("c_custkey") % 2 == 0, body).otherwise("jdbc:oracle:thin:@host")).alias("sensitive"))


REDACT_CONNECTIONS = r"""
SELECT c_custkey, 'use ****@db1 http://****@host/x jdbc:oracle:thin:@host:1521 key ****' || right(printf('%06d', c_custkey), 4) || ', ****' || right(printf('%06d', c_custkey), 4) || ' pwd =****;x' AS clean, c_custkey % 2 = 0 AS sensitive FROM customer
"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "case when c_custkey % 2 = 0 then concat('${a.b', c_custkey, ':1}') else concat(char(39), 'x', c_custkey, char(39)) end key", "case when c_custkey % 2 = 0 then concat('jdbc:oracle:thin:@H', c_custkey, ':1521/S') else concat('jdbc:mysql://h/db', c_custkey, '?x=1') end url", "concat(c_name, '\n', c_mktsegment, '\n', c_name) body")
    return rows.select("id", text.normalised_key(F.col("key")).alias("key"), text.datasource_key(F.col("url")).alias("datasource"), text.bounded_summary(F.col("body"), 32).alias("summary"))


TEXT_RULES = """
WITH c AS (SELECT *, c_name || chr(10) || c_mktsegment || chr(10) || c_name AS body FROM customer)
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a.b' || c_custkey ELSE 'x' || c_custkey END AS key, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey || ':1521/s' ELSE 'h/db' || c_custkey END AS datasource,
  CASE WHEN length(body) <= 32 THEN body WHEN length(c_name || c_mktsegment) + 2 <= 32 THEN c_name || chr(10) || c_mktsegment ELSE c_name END AS summary FROM c
"""


def scratch(spark: SparkSession) -> str:
    """The shared folder; one of our own on a single machine (tests) where it is not set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"file://{tempfile.mkdtemp(prefix='evidentia-plans-')}"


def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream once, debounced, into a table; what the watermark has not passed is not put out."""
    source = table(spark, sf_dir, "events")
    place = f"{scratch(spark)}/stream-{spark.sql('select uuid()').first()[0]}"
    out, state = f"{place}/out", f"{place}/state"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    bursts = watcher.debounced(stream.withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "user_id", late="1 hour")
    query = watcher.on_change(bursts, lambda batch, _: batch.write.mode("append").parquet(out), state)
    query.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(out).select("user_id", F.unix_micros("started").alias("started_us"), F.unix_micros("flushed").alias("flushed_us"), "n_events")


STREAM_INCREMENTAL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 7200000000 AS flushed_us, count(*) AS n_events FROM s GROUP BY user_id, burst HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
"""


def term_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "term string", [("DynamicChargingBatchOperation",), ("SMS_REMINDER",), ("SMSReminderJob",), ("plain",), ("a_b_c_d",)])
    return rows.select("term", F.array_join(text.term_expansions(F.col("term")), ",").alias("expansions"))


TERM_EXPANSION = """SELECT * FROM (VALUES ('DynamicChargingBatchOperation', 'DynamicChargingBatchOperation,DynamicChargingBatch,DynamicCharging'), ('SMS_REMINDER', 'SMS_REMINDER'),
  ('SMSReminderJob', 'SMSReminderJob,SMSReminder'), ('plain', 'plain'), ('a_b_c_d', 'a_b_c_d,a_b_c,a_b')) t(term, expansions)"""


def provider_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, "literal").otherwise("concat").alias("recovery_mode"), (F.col("p_size") % 2 == 0).alias("branched"), (F.col("p_partkey") % 4 == 0).alias("has_comment"), (F.col("p_partkey") % 3).alias("evidence_count"))
    score = scores.lineage_provider_score(parts, 4000)
    return score.withColumns({"config": scores.config_provider_score(F.lit(3), F.lit(4), F.lit(0.8)), "code": scores.code_provider_score(F.lit(0.6))})


PROVIDER_SCORES = """
WITH m AS (SELECT CASE WHEN p_size > 25 THEN 1.0 ELSE 0.7 END::DOUBLE - CASE WHEN p_size % 2 = 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS w, (p_partkey % 4 = 0)::INT::DOUBLE AS c, (p_partkey % 3 >= 2)::INT::DOUBLE AS e FROM part)
SELECT count(*) AS n, round(0.3::DOUBLE * least(1.0::DOUBLE, count(*) / 4000.0::DOUBLE) + 0.25::DOUBLE * avg(w) + 0.2::DOUBLE * avg(c) + 0.15::DOUBLE * avg(e), 4) AS score, 0.6::DOUBLE AS config, 0.54::DOUBLE AS code FROM m
"""


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as markdown and read back."""
    rows = table(spark, sf_dir, "conversations").selectExpr("concat_ws('-', conv_id, turn) case_id", "concat('\"', role, '\" said') signature", "text root_cause")
    return files.cases_from_markdown(files.case_markdown(rows).select(F.col("markdown").alias("content")), "case_id string, signature string, root_cause string")


CASE_FILES = """SELECT conv_id || '-' || turn AS case_id, '"' || role || '" said' AS signature, text AS root_cause FROM conversations"""


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [("s", 0, 0, "Title"), ("s", 1, 0, "Function Name"), ("s", 1, 1, "Type"), ("s", 2, 0, "CMPK_USER via API"), ("s", 2, 1, "EI"), ("s", 3, 0, "Subtotal"), ("s", 3, 1, "9"), ("s", 4, 0, "CB_CUST"), ("s", 4, 1, "EO")]
    rows = files.sheet_rows(values(spark, "sheet string, row int, col int, value string", cells), {"name": ["function name"], "kind": ["type"]})
    return rows.withColumns({"tables": F.array_join(text.table_like_tokens(F.col("value"), ["CB_"]), ","), "acronyms": F.array_join(text.acronyms(F.col("value"), ["CB_"]), ",")})


SHEET_ROWS = """SELECT * FROM (VALUES ('s', 2, 'name', 'CMPK_USER via API', 'CMPK_USER', 'API'), ('s', 2, 'kind', 'EI', '', 'EI'), ('s', 4, 'name', 'CB_CUST', 'CB_CUST', ''), ('s', 4, 'kind', 'EO', '', 'EO')) t(sheet, "row", field, value, tables, acronyms)"""


_ALL = (
    term_expansion, provider_scores, case_files, sheet_rows,
    source_scan, properties_items, tree_items, spring_beans, mapper_statements, mapper_closure, ddl_columns, tns_aliases, jsonl_methods, readonly_gate, email_body, segments, segment_groups, sanitize_text,
    redact_connections, text_rules, stream_incremental,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
