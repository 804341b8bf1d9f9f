"""Dictionary scans over JDBC, against Spark's own Derby in memory."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.sources.dictionary import dump_reader, jdbc_reader, refreshed, scan
from evidentia.sources.snapshots import SnapshotStore

SQL = "SELECT OWNER, TABLE_NAME, 10 / N AS PAGES FROM TABS"
OWNERS = ["A", "B", "C", "O'D", "E"]


@pytest.fixture(scope="module")
def instances(spark):
    out = {}
    for name in ("TEST1", "TEST2"):
        url = f"jdbc:derby:memory:dictionary_{name.lower()};create=true"
        out[name] = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        rows = [(o, f"{name}_{o}_{i}", 2) for o in OWNERS[:4] for i in range(5)] + [("BAD", "X", 0)]
        frame = spark.createDataFrame(rows, "OWNER string, TABLE_NAME string, N int").coalesce(1)
        frame.write.format("jdbc").options(**out[name], dbtable="TABS", createTableColumnTypes="OWNER VARCHAR(40), TABLE_NAME VARCHAR(80)").mode("overwrite").save()
    return out


def said(found):
    return {(r["instance"], r["owner"]): (r["n_rows"], r["status"]) for r in found.report.collect()}


def test_groups_are_tasks_of_one_job(spark, instances):
    routes = [(o, "TEST1") for o in OWNERS] + [("A", "TEST2"), ("A", "TEST2"), ("Z", None)]
    found = scan(spark, jdbc_reader(spark, instances, SQL, "OWNER"), routes, ["test1", "test2"], owner_col="OWNER", group=2)
    assert said(found) == {("TEST1", o): (5, "ok") for o in OWNERS[:4]} | {("TEST1", "E"): (0, "empty"), ("TEST2", "A"): (5, "ok"), (None, "Z"): (0, "failed")}
    rows = found.rows.collect()
    assert len(rows) == 25 == len({r["TABLE_NAME"] for r in rows}) and {r["PAGES"] for r in rows} == {5}
    assert all(r["TABLE_NAME"].startswith(r["scanned_instance"]) for r in rows)


def test_a_failed_owner_costs_no_other_its_rows(spark, instances):
    routes = [(o, "TEST1") for o in [*OWNERS, "BAD"]]
    for group in (1, 2, 50):
        found = scan(spark, jdbc_reader(spark, instances, SQL, "OWNER"), routes, ["TEST1"], owner_col="OWNER", group=group)
        assert said(found)[("TEST1", "BAD")] == (0, "failed") and found.rows.count() == 20
        (reason,) = [r["reason"] for r in found.report.collect() if r["status"] == "failed"]
        assert "zero" in reason


def test_caps(spark, instances):
    read = jdbc_reader(spark, instances, SQL, "OWNER")
    found = scan(spark, read, [(o, "TEST1") for o in OWNERS], ["TEST1"], owner_col="OWNER", group=3, cap=4)
    # E has no rows; O'D is read with it and within the group's ceiling, so it is whole
    assert said(found) == {("TEST1", o): (4, "truncated") for o in "ABC"} | {("TEST1", "O'D"): (5, "ok"), ("TEST1", "E"): (0, "empty")}
    counts = {r["OWNER"]: r["count"] for r in found.rows.groupBy("OWNER").count().collect()}
    assert counts == {"A": 4, "B": 4, "C": 4, "O'D": 5}
    assert read("TEST1", ["A", "B"], 7).count() == 7 and read("TEST1", ["A"], 7).rdd.getNumPartitions() == 1


def test_gates(spark, instances):
    with pytest.raises(ValueError, match="SELECT"):
        jdbc_reader(spark, instances, "DELETE FROM TABS", "OWNER")
    with pytest.raises(ValueError, match="production"):
        jdbc_reader(spark, {"T": {"url": "jdbc:derby:memory:prod1"}}, SQL, "OWNER")

    def never(*_):
        raise AssertionError("was read")

    for name in ("PROD1", "OTHER"):
        with pytest.raises(ValueError, match="refused"):
            scan(spark, never, [("A", name)], ["PROD1", "TEST1"], owner_col="OWNER")


def test_nothing_to_read(spark):
    found = scan(spark, dump_reader({}, "o", ["o"]), [], [], owner_col="o")
    assert found.rows.columns == ["scanned_instance"] and found.rows.count() == 0 and found.report.count() == 0


def test_refresh_keeps_the_old_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    good = spark.createDataFrame([("A", 1), ("B", 2)], "o string, x int")
    bad = good.withColumn("x", F.when(F.col("o") == "B", F.raise_error("no privilege").cast("int")).otherwise(F.col("x")))

    def view(frame, routes=(("A", "T"), ("B", "T"))):
        return lambda: scan(spark, dump_reader({"T": frame}, "o", ["o"]), routes, ["T"], owner_col="o")

    first, _ = refreshed(store, {"tables": view(good), "synonyms": view(bad)}, {"tables"})
    assert store.current() == first and store.read("tables").count() == 2 and store.read("synonyms").count() == 1
    assert store.read("scan_report").filter("status = 'failed'").select("view", "owner").collect() == [("synonyms", "B")]
    for scans in ({"tables": view(bad)}, {"tables": view(good, ())}):
        assert refreshed(store, scans, {"tables"})[0] is None
        assert store.current() == first
