"""Relations of statements by their scopes, on statements that nobody shaped the operator for."""

from __future__ import annotations

import pytest

from evidentia.operators import scopes

STATEMENTS = {
    "comma": "SELECT o.id FROM orders o, customer c WHERE o.cust = c.id",
    "recursive": "WITH RECURSIVE r AS (SELECT id, up FROM tree UNION ALL SELECT t.id, t.up FROM tree t JOIN r ON t.up = r.id) SELECT * FROM r",
    "extract": "SELECT extract(year FROM d.day) FROM days d",
    "call": "SELECT a FROM main m WHERE m.x IN (SELECT MAX(y) FROM t GROUP BY z)",
    "nested": "SELECT a FROM main m WHERE EXISTS (SELECT 1 FROM mid WHERE mid.k IN (SELECT k FROM deep d WHERE d.j = mid.j) AND mid.m = m.m)",
    "schemas": "SELECT * FROM UPC.COMMON_T a JOIN SEC.COMMON_T b ON a.id=b.id",
    "self": "SELECT * FROM T_X a JOIN T_X b ON a.pid=b.id",
    "insert": "INSERT INTO UPC.T_DST (c1, c2) SELECT s.a, upper(s.b) || s.c AS x FROM SEC.T_SRC s -- FROM nothing\n",
    "same": "INSERT INTO UPC.COMMON_T SELECT * FROM SEC.COMMON_T",
    "cross": "SELECT * FROM UPC.COMMON_T a WHERE a.id IN (SELECT b.id FROM SEC.COMMON_T b)",
    "exists": "SELECT * FROM UPC.COMMON_T a WHERE EXISTS (SELECT 1 FROM SEC.COMMON_T b WHERE b.pid=a.id)",
    "update": "UPDATE stock s SET n = (SELECT max(m.n) FROM moves m WHERE m.id = s.id) WHERE s.id IN (SELECT id FROM todo)",
    "delete": "DELETE FROM old WHERE id IN (SELECT id FROM gone /* , FROM hidden */)",
    "merge": "MERGE INTO target t USING (SELECT id, a FROM source) s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.a = s.a",
    "ctas": "CREATE TABLE copy_t AS SELECT l.k, 'FROM lies' AS lie FROM ledger@link.world l",
    "through": "WITH base AS (SELECT o.id AS oid, o.cust FROM sales.orders o), two AS (SELECT oid, cust AS who FROM base) INSERT INTO mart.sums (a, b) SELECT d.oid, c.name FROM (SELECT * FROM two) d JOIN customer c ON d.who = c.id",
    "union": "INSERT INTO both_t SELECT a.x FROM one a UNION ALL SELECT b.y FROM other b WHERE b.k = 1",
    "garbage": "NOT SQL AT ALL @@@ ###",
    "blank": " ",
    "null": None,
    "odd": "SELECT ) FROM ( t",
    "values": "INSERT INTO logs (a) VALUES (1)",
    "oracle": "SELECT * FROM emp e, dept d WHERE e.dno = d.no (+) AND e.n = 3",
}


@pytest.fixture(scope="module")
def statements(spark):
    return spark.createDataFrame([*STATEMENTS.items()], "template_id string, sql_text string")


def by_statement(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], set()).add(tuple(r[1:]))
    return out


def test_tables(statements):
    got = by_statement(scopes.tables_read(statements).collect())
    names = {k: {".".join(filter(None, x)) for x in v} for k, v in got.items()}
    assert names == {
        "comma": {"ORDERS", "CUSTOMER"}, "recursive": {"TREE"}, "extract": {"DAYS"}, "call": {"MAIN", "T"}, "nested": {"MAIN", "MID", "DEEP"},
        "schemas": {"UPC.COMMON_T", "SEC.COMMON_T"}, "self": {"T_X"}, "insert": {"UPC.T_DST", "SEC.T_SRC"}, "same": {"UPC.COMMON_T", "SEC.COMMON_T"},
        "cross": {"UPC.COMMON_T", "SEC.COMMON_T"}, "exists": {"UPC.COMMON_T", "SEC.COMMON_T"}, "update": {"STOCK", "MOVES", "TODO"}, "delete": {"OLD", "GONE"},
        "merge": {"TARGET", "SOURCE"}, "ctas": {"COPY_T", "LEDGER"}, "through": {"SALES.ORDERS", "MART.SUMS", "CUSTOMER"}, "union": {"BOTH_T", "ONE", "OTHER"},
        "values": {"LOGS"}, "oracle": {"EMP", "DEPT"},
    }


def test_relations(statements):
    rows = scopes.relations(statements).select("template_id", "src_schema", "src_table", "src_col", "dst_schema", "dst_table", "dst_col", "relation_type").collect()
    dotted = lambda *parts: ".".join(filter(None, parts))
    got = {k: {(dotted(*x[:3]), dotted(*x[3:6]), x[6]) for x in v} for k, v in by_statement(rows).items()}
    assert got == {
        "comma": {("ORDERS.CUST", "CUSTOMER.ID", "WHERE_EQ")},
        "call": {("T", "MAIN", "SUBQUERY")},
        "nested": {("MID", "MAIN", "EXISTS"), ("DEEP", "MAIN", "EXISTS"), ("DEEP", "MAIN", "SUBQUERY")},
        "schemas": {("UPC.COMMON_T.ID", "SEC.COMMON_T.ID", "JOIN")},
        "insert": {("SEC.T_SRC", "UPC.T_DST", "INSERT_SELECT")},
        "same": {("SEC.COMMON_T", "UPC.COMMON_T", "INSERT_SELECT")},
        "cross": {("SEC.COMMON_T", "UPC.COMMON_T", "SUBQUERY")},
        "exists": {("SEC.COMMON_T", "UPC.COMMON_T", "EXISTS")},
        "update": {("MOVES", "STOCK", "UPDATE_FROM"), ("TODO", "STOCK", "UPDATE_FROM"), ("TODO", "MOVES", "SUBQUERY")},
        "delete": {("GONE", "OLD", "DELETE_FROM"), ("GONE", "OLD", "SUBQUERY")},
        "merge": {("SOURCE", "TARGET", "MERGE"), ("TARGET.ID", "SOURCE.ID", "JOIN")},
        "ctas": {("LEDGER", "COPY_T", "INSERT_SELECT")},
        "through": {("SALES.ORDERS", "MART.SUMS", "INSERT_SELECT"), ("CUSTOMER", "MART.SUMS", "INSERT_SELECT"), ("SALES.ORDERS.CUST", "CUSTOMER.ID", "JOIN")},
        "union": {("ONE", "BOTH_T", "INSERT_SELECT"), ("OTHER", "BOTH_T", "INSERT_SELECT")},
        "oracle": {("EMP.DNO", "DEPT.NO", "WHERE_EQ")},
    }


def test_columns_through_scopes(statements):
    got = by_statement(scopes.column_lineage(statements).collect())
    assert got == {
        "insert": {("SEC", "T_SRC", "A", "UPC", "T_DST", "C1"), ("SEC", "T_SRC", "B", "UPC", "T_DST", "C2"), ("SEC", "T_SRC", "C", "UPC", "T_DST", "C2")},
        "same": {("SEC", "COMMON_T", "*", "UPC", "COMMON_T", "*")},
        "ctas": {("", "LEDGER", "K", "", "COPY_T", "K")},
        "through": {("SALES", "ORDERS", "ID", "MART", "SUMS", "A"), ("", "CUSTOMER", "NAME", "MART", "SUMS", "B")},
        "union": {("", "ONE", "X", "", "BOTH_T", "X"), ("", "OTHER", "Y", "", "BOTH_T", "Y")},
    }
