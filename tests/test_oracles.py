"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from evidentia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return round(value, 9) if isinstance(value, float) else str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_agree_with_sql(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
