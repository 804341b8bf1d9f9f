"""Bursts of changes over restarts, failed flushes and batches of any cut."""

from __future__ import annotations

import datetime as dt

import pytest

from evidentia.streaming.bursts import STATE_STORE, changed_files, flushed, watched

SCHEMA = "root string, path string, ts timestamp"
BASE = 1_700_000_000


@pytest.fixture
def run(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    got = []

    def once(batch, fail=False):
        rows = [(r, p, dt.datetime.fromtimestamp(BASE + s, dt.timezone.utc) if s is not None else None) for r, p, s in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        again(fail)

    def again(fail=False):
        def flush(rows, number):
            if fail:
                raise RuntimeError("flush failed")
            got.extend((r["root"], r["path"], r["started_us"] // 1_000_000 - BASE, r["flushed_us"] // 1_000_000 - BASE, r["n_events"]) for r in rows.collect())

        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        kept = events.filter(watched(events["path"], [".java"], ["target"]))
        flushed(changed_files(kept, 10, "0 seconds", key="root"), flush, str(tmp_path / "at")).awaitTermination()

    yield once, again, got
    spark.conf.set(name, before)


def test_state_outlives_restarts_and_failed_flushes(run):
    once, again, got = run
    once([("A", "b.java", 5), ("A", "a.java", 0), ("A", "a.java", 3), ("A", "target/x.java", 4), ("A", "x.txt", 4), (None, "n.java", 1), ("A", None, 1), ("A", "n.java", None)])
    assert got == []
    with pytest.raises(Exception, match="flush failed"):
        once([("A", "c.java", 100), ("B", "z.java", 100), ("A", "c.java", 109), ("A", "d.java", 119)], fail=True)
    assert got == []
    again()
    first = [("A", "a.java", 0, 15, 2), ("A", "b.java", 0, 15, 1)]
    # 109 and 119 are ten seconds apart: two bursts that came in one batch, the first over as soon as the second begins
    second = [("A", "c.java", 100, 119, 2), ("B", "z.java", 100, 110, 1)]
    assert sorted(got) == sorted(first + second)
    again()
    once([("B", "y.java", 200)])
    assert sorted(got) == sorted([*first, *second, ("A", "d.java", 119, 129, 1)])
