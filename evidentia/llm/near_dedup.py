"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, per_worker, runs, text_runs, written
from .components import components
from .shingles import U64, WordHashes, linked, mixed, shingle_sets

U32 = np.uint32


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the 2**32 positions (a bijective integer mix, in place of a table of that length)."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation places every shingle on a ring of 2**32 positions, and coordinate k
    is the least value that the second permutation, shifted round the ring by k, gives to a set's positions."""
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ring = (mixed(np.concatenate(sets) ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(U32)
    out = np.empty((len(sets), coordinates), U32)
    slab = 1 << 15  # positions at a time, so that the work stays in cache; sets are not cut
    edges = [*runs(lengths.tolist(), slab)]
    with np.errstate(over="ignore"):
        for first, last in edges:
            part = ring[starts[first] : starts[last - 1] + lengths[last - 1]]
            at = starts[first:last] - starts[first]
            for k in range(coordinates):
                out[first:last, k] = np.minimum.reduceat(second_permutation(part + U32(k)), at)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int, rows: int) -> DataFrame:
    """(doc, body, n_shingles, same_a, same_b, bands): the text's hash, set size, set identity, band keys."""
    bands = coordinates // rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker(("word hashes",), WordHashes)
        for batch in batches:
            for first, _, texts in text_runs(batch.column(1)):
                sets = shingle_sets(texts, width, hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                same = np.zeros((n, 2), U64)
                keys = np.zeros((n, bands), U64)
                if full:
                    with np.errstate(over="ignore"):
                        for i in full:
                            m = mixed(sets[i])
                            same[i] = m.sum(dtype=U64), mixed(m).sum(dtype=U64)
                        sig = signatures([sets[i] for i in full], coordinates)
                        wide = sig.astype(U64)
                        acc = np.broadcast_to(np.arange(bands, dtype=U64), (len(full), bands)).copy()
                        for r in range(rows):
                            acc = mixed(acc * U64(0x9E3779B97F4A7C15) + wide[:, r::rows][:, :bands])
                        keys[full] = acc
                flat = pa.array(keys.reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        *(pa.array(same[:, j].copy().view(np.int64)) for j in (0, 1)),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    ["doc", "body", "n_shingles", "same_a", "same_b", "bands"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    return map_batches(source, task, "doc long, body long, n_shingles long, same_a long, same_b long, bands array<long>")


def with_texts(wanted: DataFrame, classes: DataFrame, texts: DataFrame, few_rows: int = 500_000) -> DataFrame:
    """wanted(node, ...) with the text of each class: of its first document, whose id and text's hash classes has.

    Up to few_rows rows (some 30 MB) what is wanted goes to the texts by broadcast, so that only wanted texts are
    shuffled; beyond, both sides are shuffled by document.
    """
    few = wanted.count() <= few_rows
    own = classes.select("node", F.col("chief").alias("doc"), "body")
    placed = own.join(F.broadcast(wanted) if few else wanted, "node")
    return texts.join(F.broadcast(placed) if few else placed, ["doc", "body"])


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, members: int = 512) -> DataFrame:
    """(a, b, share, is_link) for pairs(a, b) of classes, from the whole texts(doc, body, text); share is their Jaccard
    similarity.

    b's text travels to a's; a's own text is put in front. A pivot with many partners is dealt into groups of about
    `members` partners, each with a copy of the pivot's text, and partitions are read row by row, so that a task holds
    one pivot's set and a batch of texts whatever the size of a group.
    """
    sizes = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / members).cast("int").alias("parts")), "pivots")
    dealt, several = pairs.select("a", F.lit(0).alias("part"), "b"), sizes.filter("parts > 1")
    if not several.isEmpty():
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = pairs.join(several, "a", "left").select("a", part.alias("part"), "b")
    pivots = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    # written, as it is counted and then read twice
    wanted = written(dealt.withColumn("node", F.col("b")).unionByName(pivots.withColumn("node", F.col("a"))), "wanted")
    rows = with_texts(wanted, classes, texts).select("a", "part", "b", "text")
    rows = rows.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, pivot = per_worker(("word hashes",), WordHashes), None, None
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            bs = batch.column(2).to_pylist()
            out: list[tuple] = []
            for first, _, texts_here in text_runs(batch.column(3)):
                for i, own in enumerate(shingle_sets(texts_here, width, hashes), first):
                    if bs[i] is None:
                        at, pivot = groups[i], own
                        continue
                    if at != groups[i]:
                        raise ValueError("a pivot's text must come before its partners'")
                    common = len(pivot) + len(own) - len(np.unique(np.concatenate((pivot, own))))
                    out.append((groups[i][0], bs[i], common / max(1, len(pivot) + len(own) - common), linked(pivot, own, percent)))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], ["a", "b", "share", "is_link"])

    return map_batches(rows, task, "a long, b long, share double, is_link boolean")


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, slab: int = 4096) -> Iterator[tuple[int, int]]:
    """Linked pairs of left x right (places in sets), from products of a shingle incidence matrix a slab at a time."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    live = shared[place]
    rows, columns = owner[live], column[place[live]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(columns, np.arange(0, shared.sum() + slab, slab))
    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
        hit = np.zeros((len(sets), slab), np.float32)
        hit[rows[x:y], columns[x:y] - k * slab] = 1
        common += hit[left] @ hit[right].T
    size = np.array([len(s) for s in sets], np.float64)
    union = size[left][:, None] + size[right][None] - common
    for i, j in zip(*np.nonzero((100 * common.astype(np.float64) >= percent * union) & (common > 0)), strict=True):
        yield int(left[i]), int(right[j])


def linked_in_blocks(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 256, block_shingles: int = 200_000) -> DataFrame:
    """(a, b): links between members(home, node, component) of one home that lie in different components.

    A home's members are dealt into blocks of about `block` members or block_shingles shingles: a large component has
    blocks of its own, the small ones share some. Two blocks meet in one task, which compares them as matrices, unless
    both are of the same component: what is verified already is not gone through again. A component of m members and
    s members of others are m * s / block rows, not a row for each pair.
    """
    pool = F.lit(-1).cast("long")
    sized = members.join(classes.select("node", "n_shingles"), "node")
    counts = sized.groupBy("home", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    slots = counts.withColumn("slot", F.when(2 * F.col("n") >= block, F.col("component")).otherwise(pool))
    parts = F.ceil(F.greatest(F.sum("n") / block, F.sum("shingles") / block_shingles)).cast("int")
    groups = written(slots.groupBy("home", "slot").agg(parts.alias("parts")), "groups")
    blocks = groups.select("home", "slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = slots.select("home", "component", "slot").join(groups, ["home", "slot"])
    placed = members.join(own, ["home", "component"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("home", "node", "component", "slot", "part")
    x, y = (blocks.select("home", F.struct("slot", "part").alias(side)) for side in ("i", "j"))
    met = x.join(y, "home").filter((F.col("i") <= F.col("j")) & ((F.col("i.slot") != F.col("j.slot")) | (F.col("i.slot") == pool)))
    meeting = F.xxhash64("i.slot", "i.part", "j.slot", "j.part").alias("meeting")
    at = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", F.lit(True).alias("left"), F.lit(True).alias("right")))).otherwise(F.array(F.struct("i", F.lit(True).alias("left"), F.lit(False).alias("right")), F.struct(F.col("j").alias("i"), F.lit(False).alias("left"), F.lit(True).alias("right"))))).alias("at")
    asked = met.select("home", meeting, at).select("home", "meeting", "at.i.slot", "at.i.part", "at.left", "at.right")
    wanted = written(placed.join(asked, ["home", "slot", "part"]).select("home", "node", "component", "meeting", "left", "right"), "blocks")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets([t or "" for t in group["text"]], width, per_worker(("word hashes",), WordHashes))
        component, node = group["component"].to_numpy(), group["node"].to_numpy()
        left, right = np.flatnonzero(group["left"].to_numpy()), np.flatnonzero(group["right"].to_numpy())
        found = [sorted((int(node[x]), int(node[y]))) for x, y in links_within(sets, left, right, percent) if component[x] != component[y]] if len(left) and len(right) else []
        return pd.DataFrame({"a": [x for x, _ in found], "b": [y for _, y in found]}, dtype="int64")

    rows = with_texts(wanted, classes, texts).select("home", "meeting", "node", "component", "left", "right", "text")
    return rows.groupBy("home", "meeting").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    coordinates: int = 128,
    rows: int = 4,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; links have 100 * intersection >= percent * union.

    1. Every text becomes its set of word shingles, a circulant MinHash signature and band keys; no text is shuffled.
       Texts of equal sets (128-bit sums) are one class. Classes are numbered, and links are between their numbers.
    2. Each band bucket links its members to one of them only, its pivot, so a bucket of any size gives a pair per
       member and band at most, and those are verified on full sets. Components are formed from the links found.
       While buckets over several components leave far more pairs than they have members, they get another pivot,
       from a component that the first one is not in, and components are formed again, as long as that leaves a third
       less pairs each time; this saves work and changes no result.
    3. In buckets that still lie in several components, pairs across components are due.
       Each member gets a home, the smallest pivot within two steps over buckets; members of one home (a text and its
       many copies at all distances, as a rule) are compared block by block, as matrices. Pairs of different homes are
       verified one by one, but for those that the distances to the bucket's pivot rule out by the triangle inequality
       of the Jaccard distance, which loses none. Then components are formed again.

    A pair at the threshold is missed with probability (1 - 0.75**4)**32 = 5e-6, less above it. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows of the same id are one document, which all
    their texts link. Rows with a null id are in the result with null component and kept. An empty table gives no rows.
    Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    marks = written(sketch(base, "doc", "text", width, coordinates, rows), "sketch")
    known = marks.filter("doc is not null and n_shingles > 0")
    same = ["same_a", "same_b", "n_shingles"]
    first_of = known.groupBy(*same).agg(F.min(F.struct("doc", "body")).alias("first"))
    classes = written(first_of.select(*same, F.col("first.doc").alias("chief"), F.col("first.body").alias("body"), F.monotonically_increasing_id().alias("node")), "classes")
    member = written(known.join(classes.select(*same, "node"), same).select("doc", "node").distinct(), "members")
    several = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc", "a")
    by_id = member.join(several, "doc").filter("node > a").select("a", F.col("node").alias("b"))

    chiefs = known.join(classes.select(F.col("chief").alias("doc"), "body", "node"), ["doc", "body"]).dropDuplicates(["node"])
    buckets = written(chiefs.select("node", F.posexplode("bands").alias("band", "key")), "buckets")
    pivots = written(buckets.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "pivots")

    star = buckets.join(pivots, ["band", "key"]).filter("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = written(star.distinct(), "pairs")
    first = checked = written(verified(pairs, classes, base, width, percent), "verified")
    discard(pairs)
    links = written(first.filter("is_link").select("a", "b").unionByName(by_id), "linked")
    own = components(links)

    def over_components(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that lie in several components; only these are looked at again."""
        placed = rows.join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # written, so that the join has exchanges of its own, which AQE can split where a bucket is large
        ends = written(placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key"), "mixed")
        return written(placed.join(ends, ["band", "key"]), "side")

    side = over_components(buckets.join(pivots.drop("n"), ["band", "key"]))
    turn, before = 0, float("inf")
    while True:
        counts = side.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
        over = counts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
        members, due = over.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()
        if (due or 0) <= 64 * (members or 0) or 3 * due > 2 * before:
            break
        turn, before = turn + 1, due
        # a member of the least component and one of the largest, of which one at least is not the pivot's
        who, order = F.struct("node", "component"), F.struct("component", F.xxhash64(F.lit(turn), "node"))
        ends = side.groupBy("band", "key").agg(F.max(F.when(F.col("node") == F.col("pivot"), F.col("component"))).alias("done"), F.min_by(who, order).alias("low"), F.max_by(who, order).alias("high"))
        chosen = written(ends.select("band", "key", F.when(F.col("low.component") != F.col("done"), F.col("low")).otherwise(F.col("high")).alias("next")), "chosen")
        pairs = side.join(chosen, ["band", "key"]).filter("component <> next.component").select(F.least("next.node", "node").alias("a"), F.greatest("next.node", "node").alias("b")).distinct()
        pairs = written(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        more = written(verified(pairs, classes, base, width, percent), "verified")
        checked = checked.unionByName(more)
        discard(pairs, chosen)
        if more.filter("is_link").isEmpty():
            break
        links = written(links.unionByName(more.filter("is_link").select("a", "b")), "linked")
        stale, own = (own, side), components(links)
        side = over_components(side.drop("component"))
        discard(*stale)

    # what is left: pairs across components, without those of the first pivots
    reach = first.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "share")
    away = side.filter("node <> pivot").join(reach, ["pivot", "node"], "left").withColumn("away", 1.0 - F.col("share"))
    whole, side = side, written(away.select("band", "key", "pivot", "node", "component", "away"), "side")
    homes = side.groupBy("node").agg(F.min("pivot").alias("home"))
    # one step further: the smallest home that any member of a document's buckets has
    least = side.join(homes, "node").groupBy("band", "key").agg(F.min("home").alias("least"))
    homes = side.join(least, ["band", "key"]).groupBy("node").agg(F.min("least").alias("home"))
    near, side = side, written(side.join(homes, "node"), "across")
    discard(whole, near)
    at_home = linked_in_blocks(side.select("home", "node", "component").distinct(), classes, base, width, percent)
    x, y = side.alias("x"), side.alias("y")
    gap = 1 - percent / 100 + 1e-9
    same_bucket = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
    due = (F.col("x.component") != F.col("y.component")) & (F.col("x.home") != F.col("y.home"))
    possible = F.abs(F.col("x.away") - F.col("y.away")) <= gap
    across = written(
        x.join(y, same_bucket & due & possible)
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
        .join(checked.select("a", "b"), ["a", "b"], "left_anti"),
        "pairs",
    )
    further = verified(across, classes, base, width, percent).filter("is_link").select("a", "b")
    second = written(further.unionByName(at_home), "verified")
    discard(across, side, buckets, pivots)
    final = own if second.isEmpty() else components(links.unionByName(second))

    # a component goes by its smallest document
    placed = classes.select("node", "chief").join(final, "node", "left").select("node", "chief", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("chief").alias("component_id"))
    named = placed.join(smallest, "component").select("node", "component_id")
    found = member.join(named, "node").groupBy("doc").agg(F.min("component_id").alias("component_id"))
    out = marks.select("doc", "n_shingles").join(found, "doc", "left").withColumn("component_id", F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


NEAR_DEDUP_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.least, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
