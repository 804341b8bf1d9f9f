"""Two writers of a snapshot store, and a writer that died."""

from __future__ import annotations

import os

import pytest

from evidentia.sources.snapshots import Conflict, SnapshotStore


def test_one_of_two_writers_is_refused(spark, tmp_path):
    one, two = (SnapshotStore(spark, str(tmp_path)) for _ in range(2))
    base = one.replace({"t": spark.range(1)})
    late = two.write({"t": spark.range(9)})
    first = one.replace({"t": spark.range(2)})
    with pytest.raises(Conflict):
        two.commit(late, base)
    assert one.history() == [base, first] and two.read("t").count() == 2 and late not in os.listdir(tmp_path)
    again = two.replace({"t": spark.range(3)})
    assert one.history() == [base, first, again] and one.read("t").count() == 3
    with pytest.raises(Conflict):
        one.commit(one.write({"t": spark.range(1)}), None)


def test_claims_without_a_pointer(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    base = store.replace({"t": spark.range(1)})
    (tmp_path / "_claims" / "000000001").touch()
    with pytest.raises(Conflict):
        store.replace({"t": spark.range(2)})
    assert store.current() == base
    patient = SnapshotStore(spark, str(tmp_path), claim_seconds=-1)
    patient.replace({"t": spark.range(2)})
    assert store.read("t").count() == 2 and len(store.history()) == 2
