"""Merkle manifest of a dataset: a sparse forest that partitions build and a reduction tree merges.

A forest holds nodes keyed by (tree, level, index) whose parents are not known yet. Two forests merge by putting their
nodes together; whenever all siblings of a run are there (how many they are follows from the tree's known number of
leaves) they become their parent, and a tree that is down to one node becomes a leaf of the tree over all trees. The
merge is associative with the empty forest as its unit, so partitions can be merged in any grouping. A partition is a
stretch of consecutive leaves, so its forest has O(arity * log(leaves)) nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the trees of all groups.
TOP = -1
Key = tuple[int, int, int]  # tree, level, index


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width_at(leaves: int, level: int, arity: int) -> int:
    """How many nodes a tree of so many leaves has on a level."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def leaf_hash(fields: list[Column]) -> Column:
    """sha256 of all fields, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def climb(first: int, nodes: list[str], leaves: int, arity: int) -> list[tuple[int, list[str]]]:
    """(first index, nodes) of each level, from consecutive nodes of a tree's leaves: every parent whose run is whole."""
    levels, width = [(first, nodes)], leaves
    while width > 1:
        end = first + len(nodes)
        low = -(-first // arity)
        high = max(low, -(-width // arity) if end == width else end // arity)
        parents = [digest("".join(nodes[j * arity - first : (j + 1) * arity - first])) for j in range(low, high)]
        first, nodes, width = low, parents, -(-width // arity)
        levels.append((first, nodes))
    return levels


def unresolved(levels: list[tuple[int, list[str]]], arity: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, node) of the nodes that have no parent in these levels."""
    for level, (first, nodes) in enumerate(levels):
        low, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i, node in enumerate(nodes, first):
            if not low <= i // arity < low + len(above):
                yield level, i, node


def merged(nodes: dict[Key, str], leaves: dict[int, int], arity: int) -> dict[Key, str]:
    """Resolve every run that is whole, in place; returns the nodes that came about. `leaves`: of each tree."""
    made: dict[Key, str] = {}
    due = [*nodes]
    while due:
        key = due.pop()
        if key not in nodes:
            continue
        tree, level, at = key
        width = width_at(leaves[tree], level, arity)
        if width == 1:
            if tree == TOP:
                continue
            parent, value = (TOP, 0, tree), nodes.pop(key)
        else:
            run = [(tree, level, j) for j in range(at // arity * arity, min((at // arity + 1) * arity, width))]
            if not all(k in nodes for k in run):
                continue
            parent, value = (tree, level + 1, at // arity), digest("".join([nodes.pop(k) for k in run]))
        nodes[parent] = made[parent] = value
        due.append(parent)
    return made


class Stretch:
    """The consecutive leaves of one partition: the levels over each group's leaves and over the groups that are whole."""

    def __init__(self, runs: list[tuple[int, int, int, list[str]]], groups: int, arity: int) -> None:
        """runs: (tree, first index, leaves of the whole tree, leaf hashes), in order."""
        self.arity, self.leaves = arity, {TOP: groups} | {tree: total for tree, _, total, _ in runs}
        self.levels = {tree: climb(first, hashes, total, arity) for tree, first, total, hashes in runs}
        whole = [(tree, levels[-1][1][0]) for tree, levels in self.levels.items() if levels[-1][1]]
        if whole:
            self.levels[TOP] = climb(whole[0][0], [node for _, node in whole], groups, arity)

    def node(self, key: Key) -> str | None:
        tree, level, at = key
        levels = self.levels.get(tree, [])
        first, nodes = levels[level] if level < len(levels) else (0, [])
        return nodes[at - first] if first <= at < first + len(nodes) else None

    def forest(self) -> dict[Key, str]:
        return {(tree, level, at): node for tree, levels in self.levels.items() for level, at, node in unresolved(levels, self.arity) if tree == TOP or width_at(self.leaves[tree], level, self.arity) > 1}

    def siblings(self, key: Key) -> tuple[list[Key], list[Key]]:
        tree, level, at = key
        start, width = at // self.arity * self.arity, width_at(self.leaves[tree], level, self.arity)
        return [(tree, level, j) for j in range(start, at)], [(tree, level, j) for j in range(at + 1, min(start + self.arity, width))]

    def way_up(self, key: Key) -> Iterator[Key]:
        """The node and all above it, by its group's root to the root of all."""
        tree, level, at = key
        while True:
            yield tree, level, at
            if width_at(self.leaves[tree], level, self.arity) > 1:
                level, at = level + 1, at // self.arity
            elif tree == TOP:
                return
            else:
                tree, level, at = TOP, 0, tree

    def asks(self) -> set[Key]:
        """Nodes of other partitions that proofs of these leaves need: siblings on the ways up, group roots, the root."""
        wanted: set[Key] = set()
        for start in self.forest():
            for key in self.way_up(start):
                left, right = self.siblings(key)
                wanted.update(left + right)
                if key[0] == TOP and (key[1] == 0 or width_at(self.leaves[TOP], key[1], self.arity) == 1):
                    wanted.add(key)
        return {key for key in wanted if self.node(key) is None}


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], dict[Key, str], list[tuple]]]:
    """(part, plan rows, nodes of others, leaf rows) of each partition from rows in the order of (part, kind, at)."""
    part, plan, others, leaves = None, [], {}, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != part:
                if part is not None:
                    yield part, plan, others, leaves
                part, plan, others, leaves = row[0], [], {}, []
            _, kind, at, grp, who, leaf, changed, a, b, c = row
            if kind == 0:
                plan.append({"start": at, "rank": a, "first_total": b, "last_total": c})
            elif kind == 1:
                others[a, b, c] = leaf
            else:
                leaves.append((grp, who, leaf, changed))
    if part is not None:
        yield part, plan, others, leaves


def stretch_of(plan: dict, leaves: list[tuple], groups: int, arity: int) -> tuple[Stretch, list[tuple[int, int, int, int]]]:
    """The partition's stretch and its (tree, index of its first leaf, first row, end row) by group."""
    cuts = [i for i in range(len(leaves)) if not i or leaves[i][0] != leaves[i - 1][0]] + [len(leaves)]
    runs, spans = [], []
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        start = plan["start"] if k == 0 else 0
        total = plan["first_total"] if k == 0 else plan["last_total"] if j == len(leaves) else j - i
        runs.append((plan["rank"] + k, start, total, [x[2] for x in leaves[i:j]]))
        spans.append((plan["rank"] + k, start, i, j))
    return Stretch(runs, groups, arity), spans


ROWS = "part long, kind int, at long, grp string, who long, leaf string, changed string, a long, b long, c long"


def manifest(leaves: DataFrame, *, arity: int = 2, part_rows: int = 200_000, fan_in: int = 64) -> DataFrame:
    """(group, id, leaf, changed, subroot, root, steps) for each row of leaves (group string, id long, leaf, changed string).

    Leaves of a group ascend by id, a null id first, rows of one id by their hash (rows alike in both stand for one
    another). While several nodes remain, every `arity` consecutive ones become sha256 of their hexadecimal digests, the
    last run with fewer. The groups' last nodes, in the groups' byte order with null first, give the root likewise.
    steps, from the leaf up, has what stands left and right of the node in its run, so that a node's parent is
    sha256(left + node + right); `folded` goes up again from it. No leaves give no rows.

    Leaves are dealt by range of (group, id, hash, row), so a group of any size and an id of any number of rows are cut
    between tasks. A partition is of part_rows rows or what the shuffle's number of partitions gives; it alone is held
    in memory. The driver sees a few numbers a partition. The merge is a tree reduction of fan_in forests at a time
    whose rounds are written tables and not RDD.treeReduce, as proofs need the nodes that the merges use up, and a lost
    executor then costs a round at most. A partition asks by key for the few nodes of others that its proofs need.
    """
    spark = leaves.sparkSession
    held = written(leaves.toDF("grp", "who", "leaf", "changed"), "leaves")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // part_rows))
    key = F.coalesce(F.concat(F.lit("+"), "grp"), F.lit(""))
    spread = held.select(key.alias("grp"), F.col("who").cast("long").alias("who"), "leaf", "changed", F.monotonically_increasing_id().alias("row"))
    # rows of a partition are numbered in their order: the lower 33 bits are the place, the upper ones the partition
    sorted_ = spread.repartitionByRange(n_parts, "grp", "who", "leaf", "row").sortWithinPartitions("grp", "who", "leaf")
    number = F.monotonically_increasing_id()
    dealt = written(sorted_.withColumn("number", number).select(F.shiftright("number", 33).alias("part"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "grp", "who", "leaf", "changed"), "dealt")
    discard(held)
    runs = dealt.groupBy("part", "grp").agg(F.count("*").alias("n"))
    heads = runs.groupBy("part").agg(F.count("*").alias("groups"), F.min("grp").alias("first"), F.max("grp").alias("last"), F.min_by("n", "grp").alias("n_first"), F.max_by("n", "grp").alias("n_last")).collect()
    plan, groups = planned(sorted(heads, key=lambda r: r["part"]))
    if not plan:
        return spark.createDataFrame([], "grp string, who long, leaf string, changed string, subroot string, root string, steps array<struct<left:string,right:string>>")
    plan_rows = spark.createDataFrame([(part, 0, start, None, None, None, None, rank, first, last) for part, start, rank, first, last in plan], ROWS)
    own = dealt.selectExpr("part", "2 as kind", "at", "grp", "who", "leaf", "changed", "cast(null as long) a", "cast(null as long) b", "cast(null as long) c")

    def together(df: DataFrame) -> DataFrame:
        return df.repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions("part", "kind", "at")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, plans, _, rows in parts_of(batches):
            stretch, _ = stretch_of(plans[0], rows, groups, arity)
            out = [(part, False, *k, stretch.leaves[k[0]], node) for k, node in stretch.forest().items()]
            out += [(part, True, *k, None, None) for k in stretch.asks()]
            yield node_batch(out)

    nodes = "part long, ask boolean, tree long, level long, at long, leaves long, node string"
    built = written(map_batches(together(own.unionByName(plan_rows)), build, nodes), "forests")

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = {TOP: groups} | {r["tree"]: r["leaves"] for r in rows}
        forest = {(r["tree"], r["level"], r["at"]): r["node"] for r in rows}
        made = merged(forest, counts, arity)
        group = rows[0]["part"] // fan_in
        kept = [(group, False, *k, counts[k[0]], node) for k, node in forest.items()]
        return pa.Table.from_batches([node_batch(kept + [(group, True, *k, counts[k[0]], node) for k, node in made.items()])])

    layers = [built.filter("not ask").select("tree", "level", "at", "node")]
    asks, forests, left, scratch = built.filter("ask"), built.filter("not ask"), n_parts, [built]
    while left > 1:
        # in the result `ask` tells the nodes that came about from those that wait
        step = written(forests.groupBy(F.floor(F.col("part") / fan_in).alias("to")).applyInArrow(merge, nodes), "merged")
        layers.append(step.filter("ask").select("tree", "level", "at", "node"))
        forests, left = step.filter("not ask"), -(-left // fan_in)
        scratch.append(step)
    known = layers[0]
    for layer in layers[1:]:
        known = known.unionByName(layer)
    found = written(asks.select("part", "tree", "level", "at").join(known, ["tree", "level", "at"]), "answers")
    discard(*scratch)
    answers = found.selectExpr("part", "1 as kind", "cast(null as long) at", "cast(null as string) grp", "cast(null as long) who", "node as leaf", "cast(null as string) changed", "tree as a", "level as b", "at as c")

    top = top_key(groups, arity)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, plans, others, rows in parts_of(batches):
            stretch, spans = stretch_of(plans[0], rows, groups, arity)

            def node(key: Key, stretch: Stretch = stretch, others: dict = others) -> str:
                value = stretch.node(key)
                return others[key] if value is None else value

            for tree, start, first, end in spans:
                ways: dict[Key, list[tuple[str, str]]] = {}

                def way(key: Key, stretch: Stretch = stretch, node=node, ways: dict = ways) -> list[tuple[str, str]]:
                    """What stands left and right on each level from this node up; kept for the nodes above the leaves."""
                    if key not in ways:
                        up = [*stretch.way_up(key)][1:2]
                        left, right = stretch.siblings(key)
                        here = [("".join(map(node, left)), "".join(map(node, right)))] if width_at(stretch.leaves[key[0]], key[1], arity) > 1 else []
                        value = here + (way(up[0]) if up else [])
                        if key[0] != TOP and key[1] == 0:
                            return value
                        ways[key] = value
                    return ways[key]

                subroot, root = node((TOP, 0, tree)), node(top)
                for low in range(first, end, 4096):
                    high = min(end, low + 4096)
                    steps = [way((tree, 0, start + i - first)) for i in range(low, high)]
                    if start + high - first >= 1 << 16:  # ways of nodes that were passed are not needed again
                        ways.clear()
                    yield proof_batch(rows[low:high], subroot, root, steps)

    proofs = "grp string, who long, leaf string, changed string, subroot string, root string, steps array<struct<left:string,right:string>>"
    out = map_batches(together(own.unionByName(plan_rows).unionByName(answers)), prove, proofs)
    return out.withColumn("grp", F.when(F.col("grp") != "", F.expr("substring(grp, 2)")))


def top_key(groups: int, arity: int) -> Key:
    level = 0
    while width_at(groups, level, arity) > 1:
        level += 1
    return TOP, level, 0


def planned(heads: list) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(part, index of its first leaf in its group, rank of its first group, leaves of its first group, of its last) and
    the number of groups, from each partition's number of groups and the sizes of its first and last."""
    totals: dict[str, int] = {}
    for r in heads:
        totals[r["first"]] = totals.get(r["first"], 0) + r["n_first"]
        if r["groups"] > 1:
            totals[r["last"]] = totals.get(r["last"], 0) + r["n_last"]
    plan, before, rank, passed = [], None, -1, 0
    for r in heads:
        again = r["first"] == before
        rank += not again
        plan.append((r["part"], passed if again else 0, rank, totals[r["first"]], totals[r["last"]]))
        passed = (passed if again else 0) + r["n_first"] if r["groups"] == 1 else r["n_last"]
        rank += r["groups"] - 1
        before = r["last"]
    return plan, rank + 1


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "ask", "tree", "level", "at", "leaves", "node"])


def proof_batch(rows: list[tuple], subroot: str, root: str, steps: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    offsets = [0]
    for s in steps:
        offsets.append(offsets[-1] + len(s))
    sides = [pa.array([pair[k] for s in steps for pair in s], pa.string()) for k in (0, 1)]
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([subroot] * len(rows)), pa.array([root] * len(rows)), listed], ["grp", "who", "leaf", "changed", "subroot", "root", "steps"])


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proof_hash(steps: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def document_leaves(docs: DataFrame, tampered: Column | None = None, *, group_col: str = "lang", fields: tuple[str, ...] = FIELDS, counted: str = "n_chars") -> DataFrame:
    """(group, id, leaf, changed): each row's hash, and the hash of the row whose `counted` is one more where tampered holds.

    Null fields are part of the hash; a null count stays null, and a null condition is none.
    """
    own = [F.col(f) for f in fields]
    base = docs.select(F.col(group_col).alias("grp"), F.col(fields[0]).alias("who"), leaf_hash(own).alias("leaf"), *([] if tampered is None else [F.when(tampered, leaf_hash([F.col(f) + 1 if f == counted else F.col(f) for f in fields])).alias("other")]))
    return base.select("grp", "who", "leaf", "leaf" if tampered is None else F.coalesce("other", "leaf").alias("changed"))


def tampered_rows(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 0


def verified_manifest(docs: DataFrame, *, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    folded_root goes up from the leaf of the row as it is after tampering. Null ids, languages, texts and counts have a
    place in order and hash (see manifest and document_leaves); a row of a null id is not tampered with; rows of the same
    id each have a leaf, rows that agree in all fields stand for one another; an empty table gives no rows; other
    columns are not read.
    """
    proofs = manifest(document_leaves(docs, tampered_rows()), arity=arity)
    whole = proofs.select(F.col("who").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), folded(F.col("changed"), F.col("steps")).alias("folded_root"))
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 by a table of 256 steps, as DuckDB has none built in.
MERKLE_SQL = """
WITH RECURSIVE b(i, k, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM b WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
f AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 7 = 0, FALSE) AS bad FROM documents, steps),
g AS (SELECT doc_id, lang, bad, n_chars,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM f),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen((n_chars + bad::INT)::VARCHAR) || ':' || (n_chars + bad::INT), '-') || tail) AS changed FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
trees AS (SELECT lang, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang),
up(lang, level, nodes) AS (SELECT lang, 0, nodes FROM trees UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM up WHERE len(nodes) > 1),
ends AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank FROM up WHERE len(nodes) = 1),
over(level, nodes) AS (SELECT 0, list(subroot ORDER BY rank) FROM ends UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM over WHERE len(nodes) > 1),
walk(lang, pos, rank, top, level, proof, node) AS (
  SELECT p.lang, p.pos, rank, FALSE, 0, '', changed FROM p JOIN ends ON p.lang IS NOT DISTINCT FROM ends.lang
  UNION ALL
  SELECT w.lang, w.pos, w.rank, w.top OR len(u.nodes) = 1, CASE WHEN NOT w.top AND len(u.nodes) = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN len(u.nodes) = 1 THEN w.proof ELSE w.proof || coalesce(u.nodes[x.sib + 1], '') END,
    CASE WHEN len(u.nodes) = 1 THEN w.node ELSE sha256(CASE WHEN x.sib < x.own THEN u.nodes[x.sib + 1] || w.node ELSE w.node || coalesce(u.nodes[x.sib + 1], '') END) END
  FROM walk w JOIN (SELECT lang, level, nodes, FALSE AS top FROM up UNION ALL SELECT NULL, level, nodes, TRUE FROM over) u
    ON u.level = w.level AND u.top = w.top AND (w.top OR u.lang IS NOT DISTINCT FROM w.lang),
  LATERAL (SELECT (CASE WHEN w.top THEN w.rank ELSE w.pos END) >> w.level AS own, xor((CASE WHEN w.top THEN w.rank ELSE w.pos END) >> w.level, 1) AS sib) x
  WHERE NOT (w.top AND len(u.nodes) = 1))
SELECT doc_id, leaf, subroot, o.nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = o.nodes[1] AS verified
FROM p JOIN ends ON p.lang IS NOT DISTINCT FROM ends.lang JOIN walk w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos,
  (SELECT nodes FROM over WHERE len(nodes) = 1) o
WHERE w.top AND w.level = (SELECT max(level) FROM over)
"""
