"""Search over symbols, lines, passages and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.session import checkpointed


def symbols(table: DataFrame, query: str, cap: int) -> DataFrame:
    """Exact and other matches, each with its own cap so that many part matches cannot push out an exact one.

    table(name, container, file); adds match (0 to 3) and name_match_strength, ordered and cut at cap. Each side is a
    top-k, not a sort of all rows.
    """
    ranked = table.withColumn("match", text.match_rank(F.col("name"), query)).filter("match is not null")
    order = ["match", "name", "file"]
    exact = ranked.filter("match <= 1").orderBy(*order).limit(cap)
    other = ranked.filter("match > 1").orderBy(*order).limit(cap)
    both = exact.unionByName(other).orderBy(*order).limit(cap)
    return both.withColumn("name_match_strength", F.when(F.col("match") == 0, 1.0).otherwise(0.6))


def line_hits(lines: DataFrame, literals: list[str]) -> DataFrame:
    """Lines that hold any literal, without regard to case."""
    low, hit = F.lower("line"), F.lit(False)
    for literal in literals:
        hit = hit | F.contains(low, F.lit(literal.lower()))
    return lines.filter(hit)


def capped_hits(hits: DataFrame, per_file: int, limit: int, file_col: str = "doc_id") -> DataFrame:
    """At most per_file hits of a file and `limit` in all, with flags for what was cut."""
    by_file = Window.partitionBy(file_col)
    placed = hits.withColumns({"place": F.row_number().over(by_file.orderBy("lineno")), "hits_in_file": F.count("*").over(by_file)})
    kept = placed.filter(F.col("place") <= per_file)
    top = kept.orderBy(file_col, "lineno").limit(limit)
    return top.withColumn("file_truncated", F.col("hits_in_file") > per_file).drop("place")


def enclosing(hits: DataFrame, scopes: DataFrame, file_col: str = "file") -> DataFrame:
    """The innermost scope(file, name, kind, start_line, end_line) around each hit(file, lineno); null where none is.

    Among scopes that hold the line a method goes before a class, then the latest start. A scope is cut into its dyadic
    blocks (of 2**level lines, at most two a level), of which each keeps its best scope only, and a line asks for the
    blocks that hold it, one a level up to its file's longest scope. So hits and scopes meet by equality, a file of many
    of both costs their sum times a logarithm, and scopes may overlap in any way.
    """
    rank = F.struct((F.col("kind") == "method").cast("int").alias("m"), F.col("start_line").alias("line"), "name")
    held = scopes.filter("name is not null and start_line <= end_line").select(F.col(file_col).alias("__file"), F.col("start_line").cast("long").alias("lo"), (F.col("end_line").cast("long") + 1).alias("hi"), rank.alias("best"))
    longest = F.floor(F.log2(F.col("hi") - F.col("lo"))).cast("int")
    left, right = (lambda x: -F.expr(f"shiftright(-lo, {x})")), (lambda x: F.expr(f"shiftright(hi, {x})"))
    levels = held.withColumn("level", F.explode(F.sequence(F.lit(0), longest))).withColumns({"l": left("level"), "r": right("level")}).filter("l < r")
    ends = F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1))
    blocks = levels.select("__file", "level", F.explode(F.array_compact(ends)).alias("block"), "best").groupBy("__file", "level", "block").agg(F.max("best").alias("best"))
    tops = held.groupBy("__file").agg(F.max(longest).alias("top"))
    lines = hits.select(F.col(file_col).alias("__file"), "lineno").distinct()
    asked = lines.join(tops, "__file", "left").withColumn("level", F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))))
    asked = asked.withColumn("block", F.expr("shiftright(cast(lineno as bigint), level)"))
    met = asked.join(blocks, ["__file", "level", "block"], "left")
    return met.groupBy("__file", "lineno").agg(F.max("best").alias("best")).select(F.col("__file").alias(file_col), "lineno", F.col("best.name").alias("scope"))


def _grams(text: Column) -> Column:
    """The distinct pieces of one to three characters of a text, and the empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(text, i, n))))
    return F.array_distinct(pieces)


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): each pair of needles(needle) and texts(text), both taken once, where the text holds the needle.

    An index of the texts by pieces of three characters. A needle meets only the texts of its rarest piece (one of
    less than three characters those of itself), and a needle with a piece that no text has meets none, so a frequent
    piece is a join key only for needles all of whose pieces are as frequent. Nulls are left out; an empty needle is in
    every text.
    """
    wanted = needles.select("needle").filter("needle is not null").distinct()
    index = texts.select("text").filter("text is not null").distinct().select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    long = F.length("needle") >= 3
    own = F.when(long, F.filter(_grams(F.col("needle")), lambda g: F.length(g) == 3)).otherwise(F.array("needle"))
    asked = wanted.select("needle", F.size(own).alias("n"), F.explode(own).alias("gram"))
    frequency = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = asked.join(frequency, "gram").groupBy("needle").agg(F.count("*").alias("found"), F.min("n").alias("n"), F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    met = rarest.filter("found = n").select("needle", "gram").join(index, "gram")
    return met.filter(F.contains("text", "needle")).select("needle", "text")


def passages(lines: DataFrame, hits: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """(id, lineno, passage): the lines around each hit. The hit's few neighbours are joined by line number."""
    near = hits.select(id_col, F.col("lineno").alias("hit"), F.explode(F.sequence(F.col("lineno") - radius, F.col("lineno") + radius)).alias("lineno"))
    found = near.join(lines.select(id_col, "lineno", "line"), [id_col, "lineno"])
    together = F.array_sort(F.collect_list(F.struct("lineno", "line")))
    return found.groupBy(id_col, F.col("hit").alias("lineno")).agg(F.array_join(F.transform(together, lambda x: x["line"]), "\n").alias("passage"))


def best_passages(scored: DataFrame, per_doc: int, id_col: str = "doc_id") -> DataFrame:
    """The best of a document's first per_doc hits; the first among equals."""
    first = scored.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("lineno"))).filter(F.col("place") <= per_doc)
    best = F.max_by(F.struct("lineno", "score", "passage"), F.struct("score", -F.col("lineno"))).alias("best")
    return first.groupBy(id_col).agg(best).select(id_col, "best.*")


def vectors_near(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k rows nearest to a vector by Euclidean distance; a projection and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = F.sqrt(F.aggregate(F.zip_with(F.col(vector_col).cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return vectors.select(id_col, F.round(distance, 4).alias("distance")).orderBy("distance", id_col).limit(k)


def read_slice(lines: DataFrame, start: Column, end: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """Source lines start..end of each document, at most `most`, with a flag for what was cut."""
    inside = lines.filter((F.col("lineno") >= start) & (F.col("lineno") <= end))
    kept = inside.filter(F.col("lineno") < start + most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n").alias("source")
    return kept.groupBy(id_col).agg(body, (F.max(end) - F.min(start) + 1 > most).alias("truncated"))


def document_frequency(docs: DataFrame, terms: Column, least_docs: int, least_share: float, id_col: str = "doc_id") -> DataFrame:
    """(term, df) of terms found in at least least_docs documents and that share of all."""
    total = docs.agg(F.count("*").alias("total"))
    counted = docs.select(id_col, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.filter(F.col("df") >= least_docs).join(F.broadcast(total)).filter(F.col("df") / F.col("total") >= least_share).select("term", "df")


def without_excluded(rows: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Rows whose value matches none of the patterns of what may not be shown; a null value stays."""
    return rows.filter(~F.coalesce(F.col(col).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank: each row's place (from 1) in the whole order, without a task that sees all rows.

    Rows are dealt by range and sorted in their partitions; a partition's rows begin behind those of the partitions
    before it, of which there is one count each. Rows that tie in the order are ranked in any order among themselves.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    dealt = checkpointed(placed.withColumn("__part", F.shiftright("__place", 33)))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")
    rank = (F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank")
    return dealt.join(F.broadcast(before), "__part").select(*rows.columns, rank)
