"""Rows made by explode are many times the files that they come from: they must not go through the driver, and the tokens of
a task must not grow with the input."""

from __future__ import annotations

import pytest

from evidentia import session
from evidentia.operators import scopes
from evidentia.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["java_sql", "mapper_closure", "mapper_ingest", "real_tables", "subquery_relations", "sql_tables", "sql_relations", "sql_columns"])
def test_no_broadcast_by_estimate(spark, name):
    assert "Broadcast" not in plan_of(catalogue.QUERIES[name](spark, SF))


def test_partitions_follow_the_texts(spark):
    rows = spark.createDataFrame([(i, "SELECT a FROM t WHERE b IN (SELECT c FROM u)" + " -- " + "x" * 4000) for i in range(1500)], "template_id long, sql_text string")
    assert scopes.parts_of(scopes.tokens(rows)) == session.parts_for(rows, "sql_text") == 7 > spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in scopes.tables_read(rows).select("schema", "table").collect()} == {("", "T"), ("", "U")}


def test_nested_relations_are_those_of_relations(spark):
    texts = ["SELECT a FROM m WHERE x IN (SELECT y FROM n)", "select a from m where exists ( /* c */ with w as (select 1 from p) select * from w)", "INSERT INTO t (a) SELECT b FROM u", "DELETE FROM d", None]
    rows = spark.createDataFrame([*enumerate(texts)], "template_id long, sql_text string")
    wanted = scopes.relations(rows).filter("relation_type in ('SUBQUERY', 'EXISTS')")
    assert sorted(map(tuple, scopes.nested_relations(rows).collect())) == sorted(map(tuple, wanted.collect())) != []


def test_relations_of_nested_queries_need_no_origins(spark, monkeypatch):
    monkeypatch.setattr(scopes, "origins", None)
    assert scopes.nested_relations(spark.createDataFrame([(1, "SELECT a FROM m WHERE x IN (SELECT y FROM n)")], "template_id long, sql_text string")).count() == 1
