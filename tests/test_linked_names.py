"""Names behind links whose numbers have as many digits as a month."""

from __future__ import annotations

import duckdb

from evidentia.operators import lineage
from evidentia.plans import evidence_plans


def test_keys_of_six_digits_agree_with_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (p_partkey * 1009 as p_partkey) from '/root/testdata/sf0.001/part.parquet') to '{tmp_path}/part.parquet'")
    con.execute(f"create view part as from '{tmp_path}/part.parquet'")
    (tmp_path / "region.parquet").symlink_to("/root/testdata/sf0.001/region.parquet")
    mine = [tuple(r) for r in evidence_plans.linked_names(spark, str(tmp_path)).select("raw", "table", "db", "status").collect()]
    assert max(len(r[0].split("@")[0]) for r in mine) == len("t_123456")
    assert sorted(mine) == sorted(con.execute(evidence_plans.LINKED_NAMES).fetchall())


def test_months_are_cut_by_default(spark):
    names, links = spark.createDataFrame([("t_202401@a",)], "raw string"), spark.createDataFrame([("a", "db")], "link string, instance string")
    assert [r.table for r in lineage.linked_names(names, links).collect()] == ["T"]
    assert [r.table for r in lineage.linked_names(names, links, month=None).collect()] == ["T_202401"]
