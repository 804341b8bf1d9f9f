"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Mass is counted in this part of a word, so that every transfer is exact in whole numbers.
SCALE = 1 << 20


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) by water-filling, in closed form over one row per source.

    Sources take the weights in turn by code point, null last. A source whose share exceeds most * its size stops
    there and the rest is shared again by weight: with the sources in rising order of size / weight, the first so many
    stop. The windows hold one row per source, never documents, in one task: some 100 bytes for each source, so that a
    million sources are 100 MB. With more (a source for each document, say) map the column to fewer values first.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    limit = F.col("source_size").cast("double") * most
    rising = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighed.withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stops", limit / F.col("weight") <= F.col("left_words") / F.col("left_weight"))
        # the level that holds for every source that does not stop: that of the first such one
        .withColumn("level", F.min(F.when(~F.col("stops"), F.struct(limit / F.col("weight"), F.col("left_words") / F.col("left_weight")))).over(every))
    )
    return filled.select("source", "source_size", F.when(F.col("stops"), limit).otherwise(F.col("weight") * F.col("level")["col2"]).alias("target"))


def _pair(held: Column, doc: Column, seed: int) -> Column:
    """One pivotal step: mass moves between the held fractional document and the next until one of them is whole.

    The move is a up or b down, at random so that no document's expected mass changes; their sum never does.
    """
    a = F.least(held["whole"] - held["mass"], doc["mass"])
    b = F.least(held["mass"], doc["whole"] - doc["mass"])
    draw = F.pmod(F.xxhash64(F.lit(seed), held["doc"], doc["doc"], held["mass"], doc["mass"]), F.lit(1 << 40)).cast("double") / float(1 << 40)
    up = draw * (a + b).cast("double") < b.cast("double")
    return F.when(up, a).otherwise(-b)


def _fold(docs: Column, seed: int) -> Column:
    """Fold a bucket: struct(held, settled), settled being the documents that became whole and held the one that did not."""
    kind = "struct<doc:string,whole:bigint,mass:bigint>"

    def with_mass(x: Column, mass: Column) -> Column:
        return F.struct(x["doc"].alias("doc"), x["whole"].alias("whole"), mass.alias("mass"))

    def step(state: Column, doc: Column) -> Column:
        held = state["held"]
        moved = F.transform(F.array(_pair(held, doc, seed)), lambda d: F.struct(with_mass(held, held["mass"] + d).alias("x"), with_mass(doc, doc["mass"] - d).alias("y")))[0]
        pair = F.transform(
            F.array(moved),
            lambda m: F.when(
                (m["x"]["mass"] > 0) & (m["x"]["mass"] < m["x"]["whole"]),
                F.struct(m["x"].alias("held"), F.array(m["y"]).alias("settled")),
            )
            .when(
                (m["y"]["mass"] > 0) & (m["y"]["mass"] < m["y"]["whole"]),
                F.struct(m["y"].alias("held"), F.array(m["x"]).alias("settled")),
            )
            .otherwise(F.struct(F.lit(None).cast(kind).alias("held"), F.array(m["x"], m["y"]).alias("settled"))),
        )[0]
        joined = F.transform(F.array(pair), lambda p: F.struct(p["held"].alias("held"), F.concat(state["settled"], p["settled"]).alias("settled")))[0]
        return F.when(held.isNull(), F.struct(doc.alias("held"), state["settled"].alias("settled"))).otherwise(joined)

    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("settled"))
    return F.aggregate(docs, start, step)


def _middle(docs: Column, most: int) -> Column:
    """`most` documents from the middle of a list by size."""
    return F.slice(docs, F.greatest(F.lit(1), F.floor((F.size(docs) - most) / 2).cast("int") + 1), F.lit(most))


def _closed(folded: Column) -> Column:
    """The settled documents of a source's last fold, with the one still fractional among them.

    That one is rounded to the nearer side. What this is off the target is made up, as far as it goes, by turning
    settled documents over, the largest that lessens it first; the rest is then a fraction of a small document.
    """
    kind = "array<struct<doc:string,whole:bigint,mass:bigint>>"

    def turned(state: Column, x: Column) -> Column:
        off, whole, taken = state["off"], x["whole"], x["mass"] > 0
        down = (off > 0) & taken & (whole < 2 * off)
        up = (off < 0) & ~taken & (whole < -2 * off)
        mass = F.when(down, F.lit(0).cast("long")).when(up, whole).otherwise(x["mass"])
        return F.struct(
            F.when(down, off - whole).when(up, off + whole).otherwise(off).alias("off"),
            F.concat(state["out"], F.array(F.struct(x["doc"].alias("doc"), whole.alias("whole"), mass.alias("mass")))).alias("out"),
        )

    def closed(f: Column) -> Column:
        held = f["held"]
        up = held["mass"] * 2 >= held["whole"]
        whole = F.struct(held["doc"].alias("doc"), held["whole"].alias("whole"), F.when(up, held["whole"]).otherwise(F.lit(0)).cast("long").alias("mass"))
        start = F.struct(F.when(up, held["whole"] - held["mass"]).otherwise(-held["mass"]).alias("off"), F.array(whole).alias("out"))
        falling = F.transform(F.sort_array(F.transform(f["settled"], lambda x: F.struct((-x["whole"]).alias("order"), x["doc"].alias("doc"), x.alias("x")))), lambda y: y["x"])
        return F.when(held.isNull(), f["settled"].cast(kind)).otherwise(F.aggregate(falling, start, turned, lambda s: s["out"]))

    return F.transform(F.array(folded), closed)[0]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 17,
    bucket: int = 64,
    lend: int = 4,
) -> DataFrame:
    """How many copies of each row the mix takes: (id, source, size, source_size, target, copies, taken).

    Each source's rows are wanted target / source_size times. The whole part is taken as copies; the fractional parts
    are rounded by pivotal sampling with mass counted in words, so that a source's words are kept through every step;
    only the last fractional document of a source puts the words taken off the target, and that is made up by turning
    over settled documents, of which each bucket lends some (lend taken and lend left) to the next level. Buckets of about `bucket`
    documents are folded inside SQL's aggregate(); the at most one fractional document a bucket leaves goes to the
    next level, so a source of any size is a tree of small buckets (each level is a small shuffle of ids and masses).

    Draws are hashes of the seed and the ids, so reruns agree. Null texts have size 0 and are taken with the whole
    part; null sources are one source, the last. Null or repeated ids are told apart by their text's hash; rows that
    agree in id, source and text get the same copies (each is counted in the target). Other columns are not read.
    """
    body = F.col(text_col)
    kept = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(body).alias("size"), F.xxhash64(body).alias("hash"))
    kept = written(kept, "sizes").withColumn("doc", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("hash").cast("string")))
    targets = written(source_targets(kept, weights, most), "targets")

    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rated = targets.select(named.alias("src"), "source_size", "target", F.floor(rate).alias("floor"), (rate - F.floor(rate)).alias("part"))
    base = kept.withColumn("src", named).join(rated, "src")

    # rows that agree in id, source and text are one document of their summed words
    mass = (F.col("whole") * F.col("part")).cast("long")
    open_docs = (
        base.filter((F.col("size") > 0) & (F.col("part") > 0))
        .groupBy("src", "doc", "part")
        .agg((F.sum("size") * SCALE).alias("whole"))
        .select("src", "doc", "whole", mass.alias("mass"))
    )
    per_source = written(base.filter("size > 0").groupBy("src").agg(F.count("*").alias("n")), "counts")
    largest = per_source.agg(F.max("n")).first()[0] or 0  # one number to the driver: it sets the height of the tree
    settled, level = [], 0
    open_docs = open_docs.filter((F.col("mass") > 0) & (F.col("mass") < F.col("whole")))
    while True:
        width = F.greatest(F.lit(1), F.ceil(F.col("n") / float(bucket) ** (level + 1)))
        dealt = open_docs.join(per_source, "src").withColumn("width", width.cast("long")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "doc"), F.col("width")))
        # large documents first: what stays open at the end is then among the small ones as a rule
        entry = F.struct((-F.col("whole")).alias("order"), "doc", "whole", "mass")
        plain = lambda x: F.struct(x["doc"].alias("doc"), x["whole"].alias("whole"), x["mass"].alias("mass"))
        is_open = lambda x: (x["mass"] > 0) & (x["mass"] < x["whole"])
        folded = (
            dealt.groupBy("src", "bucket", "width")
            .agg(F.transform(F.sort_array(F.collect_list(entry)), plain).alias("docs"))
            .select("src", "width", _fold(F.filter("docs", is_open), seed + level).alias("f"), F.filter("docs", lambda x: ~is_open(x)).alias("lent"))
            .select("src", "width", F.col("f.held").alias("held"), F.concat("f.settled", "lent").alias("settled"))
            .select("src", "width", "held", "settled", *(_middle(F.filter("settled", pick), lend).alias(name) for name, pick in (("up", lambda x: x["mass"] > 0), ("down", lambda x: x["mass"] == 0))))
            .select(
                "src",
                F.when(F.col("width") == 1, _closed(F.struct("held", "settled"))).otherwise(F.array_except("settled", F.concat("up", "down"))).alias("settled"),
                F.when(F.col("width") > 1, F.concat(F.when(F.col("held").isNull(), F.array_except("up", "up")).otherwise(F.array("held")), "up", "down")).otherwise(F.array_except("up", "up")).alias("open"),
            )
        )
        folded = written(folded, f"fold{level}")
        settled.append(folded.select("src", F.explode("settled").alias("x")))
        open_docs = folded.select("src", F.explode("open").alias("x")).select("src", "x.*")
        level += 1
        if largest <= bucket**level:
            break
    rounded = settled[0]
    for part in settled[1:]:
        rounded = rounded.unionByName(part)
    extra = rounded.filter("x.mass > 0").select("src", F.col("x.doc").alias("doc"), F.lit(1).alias("extra"))
    copies = (F.col("floor") + F.coalesce("extra", F.lit(0))).cast("long")
    return (
        base.join(extra, ["src", "doc"], "left")
        .withColumn("copies", F.least(copies, F.lit(most).cast("long")))
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "hash", F.col("size"), F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def mixed_rows(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns are those of docs.

    Rows are told apart by id, source and text, each of which may be null. Rows that agree in all three have the same
    copies each. An empty table gives no rows.
    """
    taken = mix.filter("copies > 0").select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("hash").alias("__hash"), F.col("copies").alias("__copies")).distinct()
    own = docs.withColumn("__own", F.xxhash64(F.col(text_col)))
    same = own[id_col].eqNullSafe(taken["__id"]) & own[source_col].eqNullSafe(taken["__source"]) & (own["__own"] == taken["__hash"])
    return own.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
