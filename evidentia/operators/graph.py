"""Expansion of call and reference graphs by a bounded number of hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int, reverse: bool = False) -> DataFrame:
    """Edges reached from seeds(root, node) within `depth` hops: (root, hop, caller, callee, row_id, truncated).

    Hops are unrolled joins. A node is expanded once per root, at its first hop, so cycles end; of each node the first
    `fanout` edges by row_id are kept, and truncated says whether it had more. Each hop takes the edges of its frontier
    by a semi-join first, so only those are ranked; the cap is put on them before the join with the roots, so a hub is
    cut where it lies and never multiplies.
    """
    here, there = ("callee", "caller") if reverse else ("caller", "callee")
    of_node = Window.partitionBy(here)

    def capped(nodes: DataFrame) -> DataFrame:
        near = edges.join(nodes.select(F.col("node").alias(here)).distinct(), here, "left_semi")
        # one edge more than the cap tells a cut; the limit by rank is also put before the shuffle, so a hub stays small
        probed = near.withColumn("place", F.row_number().over(of_node.orderBy("row_id"))).filter(F.col("place") <= fanout + 1)
        return probed.withColumn("truncated", F.max("place").over(of_node) > fanout).filter(F.col("place") <= fanout).select("caller", "callee", "row_id", "truncated")

    frontier = visited = seeds.select("root", "node").distinct()
    found = []
    for hop in range(1, depth + 1):
        reached = frontier.join(capped(frontier), F.col("node") == F.col(here)).select("root", F.lit(hop).alias("hop"), "caller", "callee", "row_id", "truncated")
        found.append(reached)
        if hop < depth:
            new = reached.select("root", F.col(there).alias("node")).distinct()
            frontier = new.join(visited, ["root", "node"], "left_anti")
            visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, found)


def bare_matches(names: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, method_fqn, n): a bare name's signature if it is the only one; null where several have it."""
    fqns = methods.select("method_fqn", F.substring_index("method_fqn", "(", 1).alias("name")).distinct()
    found = names.join(fqns, "name", "left").groupBy("name").agg(F.count("method_fqn").alias("n"), F.min("method_fqn").alias("only"))
    return found.select("name", F.when(F.col("n") == 1, F.col("only")).alias("method_fqn"), "n")


def referrers(changed: DataFrame, defines: DataFrame, references: DataFrame) -> DataFrame:
    """(file, reason): changed files and the files that refer to what they define, without the changed ones."""
    touched = defines.join(changed.select("file"), "file", "left_semi").select("name").distinct()
    users = references.join(touched, "name", "left_semi").select("file").distinct().join(changed.select("file"), "file", "left_anti")
    return changed.select("file", F.lit("changed").alias("reason")).unionByName(users.select("file", F.lit("refers").alias("reason")))
