"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): the smallest node reachable from it.

    Each round merges the nodes that have the same least name among their own and their neighbours', and turns the
    links into links between what was merged, until none is left. Names are the ids in the first round, which ends
    stars round their smallest node, and fresh hashes in each later one (xxhash64 of one long is a bijection, so no two
    nodes ever share a name): a quarter of the nodes with links or more go in a round on average, whatever the shape
    and the order of ids, and some always go, so that no cap is needed. Minima are combined before the shuffle and a
    hub's links are an ordinary join side that AQE can split, so no group is gathered anywhere. Only whether links are
    left reaches the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    steps: list[DataFrame] = []
    while True:

        def name(node: str, turn: int = len(steps)) -> Column:
            return F.xxhash64(F.lit(turn), node) if turn else F.col(node)

        least = edges.groupBy("a").agg(F.min(name("b")).alias("near"))
        steps.append(written(least.select(F.col("a").alias("node"), F.least(name("a"), "near").alias("label")), "labels"))
        a, b = (steps[-1].select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        between = edges.join(a, "a").join(b, "b").filter("label_a <> label_b")
        before, edges = edges, written(between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
        discard(before)
        if edges.isEmpty():
            break
    discard(edges)
    labels = steps.pop()
    while steps:
        onward, step = labels.select(F.col("node").alias("label"), F.col("label").alias("further")), steps.pop()
        before, labels = labels, written(step.join(onward, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        discard(before, step)
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    out = written(labels.join(smallest, "label").select("node", "component"), "labels")
    discard(labels)
    return out
