"""The configuration dimension as a store: content ids, snapshots by environment, people's tables kept over builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import mask, scores
from evidentia.operators import changes, config
from evidentia.sources.snapshots import SnapshotStore

AUTOMATIC = ("sources", "snapshots", "entities", "items", "bindings")
#: People's tables by name: schema and key. Builds never write them.
PEOPLE = {
    "confirmations": ("entity_id string, decision string, decided_by string", "entity_id"),
    "owners": ("edge_id string, owner string, decided_by string", "edge_id"),
}
HISTORY = "build_id string, item_id string, file_path string, env string, key_path string, change string, value_before string, value_after string"


def built(items: DataFrame, references: DataFrame, salt: bytes) -> dict[str, DataFrame]:
    """The automatic tables from items(file_path, env, entity_key, key_path, value, order) and references(ref_key, class_fqn).

    A file is a source, with a snapshot per environment (null: the empty one); an entity is a key of one source, whatever
    its environments; of a key given twice in a snapshot the last by `order` is the item. Values are masked before anything
    is kept. All ids are hashes of what they name, so a build of the same files makes the same ids. References meet keys
    by equality, once for each distinct key; an entity that is met twice by one class is bound once, by the stronger way.
    """
    rows = items.withColumn("env", F.coalesce("env", F.lit("")))
    last = rows.groupBy("file_path", "env", "entity_key", "key_path").agg(F.max(F.struct("order", "value")).alias("last"))
    source_id = mask.content_id("src", F.col("file_path"))
    snapshot_id = mask.content_id("snap", F.col("source_id"), F.col("env"))
    kept = last.withColumn("source_id", source_id).withColumn("snapshot_id", snapshot_id).withColumn("entity_id", mask.content_id("ent", F.col("source_id"), F.col("entity_key")))
    stored = mask.sanitized_item(F.col("key_path"), F.col("last.value"), salt)
    item_id = mask.content_id("item", F.col("source_id"), F.col("key_path"), F.col("snapshot_id"))
    out = kept.select(item_id.alias("item_id"), "source_id", "snapshot_id", "entity_id", "file_path", "env", "entity_key", "key_path", stored.alias("s")).select("*", "s.*").drop("s")
    snapshots = out.select("snapshot_id", "source_id", "env").distinct()
    entities = out.select("entity_id", "source_id", "entity_key").distinct()
    met = config.bound(references.select("ref_key").distinct(), entities)
    ways = references.join(met, "ref_key").select("entity_key", "class_fqn", "strategy").distinct().join(entities, "entity_key")
    weighed = ways.withColumn("confidence", scores.looked_up(F.col("strategy"), scores.STRATEGY, 0.3))
    best = weighed.groupBy("entity_id", "class_fqn").agg(F.max(F.struct("confidence", "strategy")).alias("b"))
    bindings = best.select(mask.content_id("bind", F.col("entity_id"), F.lit("class"), F.col("class_fqn")).alias("binding_id"), "entity_id", "class_fqn", "b.strategy", "b.confidence")
    return {"sources": out.select("source_id", "file_path").distinct(), "snapshots": snapshots, "entities": entities, "items": out, "bindings": bindings}


def differences(before: DataFrame, after: DataFrame, build_id: str) -> DataFrame:
    """HISTORY rows of what differs between two tables of items: added, removed or changed. Of masked values the fingerprints
    tell whether they differ, and masks are what is kept."""
    side = lambda rows: rows.select(F.struct("item_id", "file_path", "env", "key_path").alias("key"), F.struct("value", "fingerprint").alias("value"))
    found = config.difference(side(before), side(after))
    change = F.when(F.col("change") == "only_in_a", "removed").when(F.col("change") == "only_in_b", "added").otherwise(F.col("change"))
    return found.select(F.lit(build_id).alias("build_id"), "key.*", change.alias("change"), F.col("value_a.value").alias("value_before"), F.col("value_b.value").alias("value_after"))


def rebuild(store: SnapshotStore, items: DataFrame, references: DataFrame, salt: bytes, build_id: str) -> str:
    """Replace the automatic tables, carry people's tables over as they are, and append to `history` what differs from the
    version before (nothing in the first build, or where nothing differs). Conflict if another writer came in between."""
    before = store.current()
    tables = built(items, references, salt)
    history = store.read("history", HISTORY)
    if before:
        history = history.unionByName(differences(store.read("items"), tables["items"], build_id))
    carried = {name: store.read(name, schema) for name, (schema, _) in PEOPLE.items()}
    return store.commit(store.write(tables | carried | {"history": history}), before)


def decide(store: SnapshotStore, name: str, decisions: DataFrame) -> str:
    """Put decisions into one of people's tables, in the place of earlier ones of the same key; all else is carried over.
    Several decisions of one key are an error of the caller; the greatest is kept."""
    schema, key = PEOPLE[name]
    before = store.current()
    columns = [c for c in decisions.columns if c != key]
    one = decisions.groupBy(key).agg(F.max(F.struct(*columns)).alias("d")).select(key, "d.*")
    tables = {n: store.read(n) for n in AUTOMATIC if store.exists(n)} | {n: store.read(n, s) for n, (s, _) in PEOPLE.items()} | {"history": store.read("history", HISTORY)}
    tables[name] = changes.replaced(tables[name], one, one, key)
    return store.commit(store.write(tables), before)


def effective_bindings(bindings: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Bindings with `human_confirmed`; those of an entity that people rejected are left out."""
    decided = bindings.join(confirmations.select("entity_id", "decision"), "entity_id", "left")
    return decided.filter("coalesce(decision, '') <> 'reject'").withColumn("human_confirmed", F.coalesce(F.col("decision") == "confirm", F.lit(False))).drop("decision")
