"""Builds of the configuration store: ids that stay, people's decisions that stay, and a history of what changed."""

from __future__ import annotations

import pytest

from evidentia.operators import config_store
from evidentia.sources.snapshots import Conflict, SnapshotStore

ITEMS = "file_path string, env string, entity_key string, key_path string, value string, order int"
FIRST = [
    ("a.properties", None, "port", "port", "80", 1), ("a.properties", None, "port", "port", "81", 2), ("b.yml", "dev", "port", "port", "80", 1), ("b.yml", "test", "port", "port", None, 1),
    ("b.yml", "dev", "db", "db.password", "secret-1234", 2), ("b.yml", "dev", "old.key", "old.key", "x", 3),
]
REFS = [("port", "C1"), ("port.deep", "C1"), ("old", "C2"), ("none", "C3")]


def frames(spark, items):
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(REFS, "ref_key string, class_fqn string")


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path))


def rows(store, name, *columns):
    return sorted(tuple(r) for r in store.read(name).select(*columns).collect())


def test_files_do_not_share_entities(spark, store):
    config_store.rebuild(store, *frames(spark, FIRST), b"s", "1")
    entities = rows(store, "entities", "entity_key", "source_id")
    assert [k for k, _ in entities] == ["db", "old.key", "port", "port"] and len({i for k, i in entities if k == "port"}) == 2
    assert len(rows(store, "snapshots", "snapshot_id")) == 3
    items = {(f, e, k): v for f, e, k, v in [tuple(r) for r in store.read("items").select("file_path", "env", "key_path", "value").collect()]}
    assert items[("a.properties", "", "port")] == "81" and items[("b.yml", "test", "port")] is None and items[("b.yml", "dev", "db.password")] == "****1234"
    # C1 names the key and something below it: the equal key is the stronger way, in both files
    assert rows(store, "bindings", "class_fqn", "strategy") == [("C1", "exact_match"), ("C1", "exact_match"), ("C2", "hierarchical_match")]
    assert store.read("history").count() == 0


def test_a_second_build_of_the_same_files_changes_nothing(spark, store):
    config_store.rebuild(store, *frames(spark, FIRST), b"s", "1")
    ids = {n: rows(store, n, f"{n[:-1].replace('entitie', 'entity')}_id") for n in config_store.AUTOMATIC}
    config_store.rebuild(store, *frames(spark, FIRST[::-1]), b"s", "2")
    assert ids == {n: rows(store, n, f"{n[:-1].replace('entitie', 'entity')}_id") for n in config_store.AUTOMATIC}
    assert store.read("history").count() == 0


def test_decisions_and_history_outlive_builds(spark, store):
    config_store.rebuild(store, *frames(spark, FIRST), b"s", "1")
    by_key = {(r["entity_key"], r["source_id"]): r["entity_id"] for r in store.read("entities").collect()}
    old = next(i for (k, _), i in by_key.items() if k == "old.key")
    port = next(i for (k, _), i in by_key.items() if k == "port")
    says = lambda *d: spark.createDataFrame(list(d), config_store.PEOPLE["confirmations"][0])
    config_store.decide(store, "confirmations", says((old, "confirm", "a"), (port, "confirm", "a")))
    config_store.decide(store, "confirmations", says((old, "reject", "b")))
    second = list(FIRST)
    second[4] = ("b.yml", "dev", "db", "db.password", "other-1234", 2)
    second[0:2] = [("a.properties", None, "port", "port", "82", 1), ("a.properties", "prod", "port", "port", "1", 1)]
    second.pop(3)
    config_store.rebuild(store, *frames(spark, second), b"s", "2")
    assert rows(store, "confirmations", "entity_id", "decision") == sorted([(old, "reject"), (port, "confirm")])
    assert rows(store, "history", "build_id", "file_path", "env", "change") == [("2", "a.properties", "", "changed"), ("2", "a.properties", "prod", "added"), ("2", "b.yml", "dev", "changed"), ("2", "b.yml", "test", "removed")]
    masked = store.read("history").filter("key_path = 'db.password'").select("value_before", "value_after").first()
    assert tuple(masked) == ("****1234", "****1234")
    known = config_store.effective_bindings(store.read("bindings"), store.read("confirmations")).select("class_fqn", "human_confirmed").collect()
    assert sorted(map(tuple, known)) == [("C1", False), ("C1", True)]


def test_a_decision_during_a_build_is_not_lost(spark, store, monkeypatch):
    config_store.rebuild(store, *frames(spark, FIRST), b"s", "1")
    whole = SnapshotStore.write

    def late(self, tables):
        monkeypatch.setattr(SnapshotStore, "write", whole)
        config_store.decide(store, "confirmations", spark.createDataFrame([("e", "confirm", "a")], config_store.PEOPLE["confirmations"][0]))
        return whole(self, tables)

    monkeypatch.setattr(SnapshotStore, "write", late)
    with pytest.raises(Conflict):
        config_store.rebuild(store, *frames(spark, FIRST), b"s", "2")
    assert store.read("confirmations").count() == 1
