"""Lineage edges between tables: identities, deduplication, validation, lookups, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

UNDIRECTED = ("JOIN", "WHERE_EQ")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)


def confidence_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("")


def edge_id(src: Column, dst: Column, relation: Column) -> Column:
    """E and 12 hex digits; the same both ways for relations without a direction."""
    low, high = F.least(src, dst), F.greatest(src, dst)
    both = relation.isin(*UNDIRECTED)
    key = F.concat_ws(":", F.when(both, low).otherwise(src), F.when(both, high).otherwise(dst), relation)
    return F.concat(F.lit("E"), F.upper(F.substring(F.md5(key), 1, 12)))


def deduplicated(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per edge: first columns, highest confidence, and as many evidence rows as there are (else the sum)."""
    first = F.min_by(F.struct("src_table", "dst_table", "relation_type"), F.col("row_id")).alias("first")
    grouped = edges.groupBy("edge_id").agg(first, F.max(confidence_rank(F.col("confidence"))).alias("rank"), F.sum("evidence_count").alias("given"))
    counted = evidence.groupBy("edge_id").agg(F.count("*").alias("counted"))
    return grouped.join(counted, "edge_id", "left").select(
        "edge_id", "first.*", confidence_name(F.col("rank")).alias("confidence"), F.coalesce("counted", "given").alias("evidence_count")
    )


def validated(edges: DataFrame, tables: DataFrame, fk_pairs: DataFrame) -> DataFrame:
    """Edges with a known end; one unknown end makes it low, a foreign key between the ends high (which wins)."""
    known = tables.select(F.col("name")).distinct()
    src, dst = known.select(F.col("name").alias("src_table"), F.lit(True).alias("src_known")), known.select(F.col("name").alias("dst_table"), F.lit(True).alias("dst_known"))
    fk = fk_pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct().withColumn("fk", F.lit(True))
    marked = edges.join(src, "src_table", "left").join(dst, "dst_table", "left").withColumns({"lo": F.least("src_table", "dst_table"), "hi": F.greatest("src_table", "dst_table")}).join(fk, ["lo", "hi"], "left")
    one = F.col("src_known").isNull() | F.col("dst_known").isNull()
    confidence = F.when(F.col("fk"), "high").when(one, "low").otherwise(F.col("confidence"))
    return marked.filter("src_known or dst_known").select("edge_id", "src_table", "dst_table", "relation_type", confidence.alias("confidence"))


def neighbours(edges: DataFrame, table: str, downstream: bool) -> DataFrame:
    """Distinct tables on the other side of a table's edges; the first edge by id says how they are related."""
    here, there = ("src_table", "dst_table") if downstream else ("dst_table", "src_table")
    near = edges.filter(F.col(here) == table)
    return near.groupBy(F.col(there).alias("table")).agg(F.min_by("relation_type", F.struct("edge_id", "relation_type")).alias("relation_type"), F.count("*").alias("n_edges"))


def degree(edges: DataFrame) -> DataFrame:
    """(table, edges_out, edges_in), counted in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_table").alias("t"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_table").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.t").alias("table")).agg(F.sum("e.o").alias("edges_out"), F.sum("e.i").alias("edges_in"))


def object_edges(dependencies: DataFrame, kinds: tuple[str, ...] = ("TABLE", "VIEW")) -> DataFrame:
    """Edges referenced -> dependent for dependencies on tables and views; none of an object on itself."""
    kept = dependencies.filter(F.col("referenced_type").isin(*kinds) & ((F.col("name") != F.col("referenced_name")) | (F.col("owner") != F.col("referenced_owner"))))
    src, dst = text.canonical(F.col("referenced_owner"), F.col("referenced_name")), text.canonical(F.col("owner"), F.col("name"))
    return kept.select(src.alias("src"), dst.alias("dst"), F.lit("OBJECT_DEPENDENCY").alias("edge_kind"), F.lit("DIRECT").alias("lineage_type")).distinct()


def linked_names(names: DataFrame, dblinks: DataFrame, month: str | None = text.MONTH_SUFFIX) -> DataFrame:
    """(raw, table, db, status): where a name after @ leads by dblinks(link, instance), also by the link's base name; the
    status tells local names from links that are resolved or not. month is the suffix of monthly tables, None if the
    database has none and six digits are part of a name."""
    link = F.upper(F.regexp_extract("raw", "@(.+)$", 1))
    placed = names.select("raw", text.normalised_table(F.substring_index("raw", "@", 1), month=month).alias("table"), link.alias("link"), F.substring_index(link, ".", 1).alias("base"))
    known = dblinks.select(F.upper("link").alias("link"), "instance")
    by_full, by_base = known.withColumnRenamed("instance", "by_full"), known.select(F.col("link").alias("base"), F.col("instance").alias("by_base"))
    found = placed.join(by_full, "link", "left").join(by_base, "base", "left")
    db = F.coalesce("by_full", "by_base", F.lit(""))
    return found.select("raw", "table", db.alias("db"), F.when(F.col("link") == "", "local").when(db != "", "linked").otherwise("unresolved").alias("status"))


def resolved_names(names: DataFrame, synonyms: DataFrame, metadata: DataFrame) -> DataFrame:
    """(raw, owner, table): link cut off, synonym followed, normalised; a table of several owners has a blank owner."""
    base = names.select("raw", text.normalised_table(F.substring_index("raw", "@", 1)).alias("base"))
    named = base.join(synonyms.select(F.upper("synonym").alias("base"), F.upper("target").alias("target")), "base", "left").withColumn("table", F.coalesce("target", "base"))
    owners = metadata.groupBy(F.upper("table").alias("table")).agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("only"))
    return named.join(owners, "table", "left").select("raw", F.when(F.col("n") == 1, F.col("only")).otherwise("").alias("owner"), "table")


def table_of_link(links: DataFrame, instances: DataFrame, overrides: DataFrame) -> DataFrame:
    """(link, instance): an override by full name, then by base name, then by host; else the instance of the descriptor."""
    full = overrides.select(F.col("name").alias("link"), F.col("instance").alias("by_full"))
    base = overrides.select(F.col("name").alias("base"), F.col("instance").alias("by_base"))
    host = overrides.select(F.col("name").alias("host"), F.col("instance").alias("by_host"))
    descriptor = instances.select("host", "service", F.col("instance").alias("by_descriptor"))
    found = links.withColumn("base", F.substring_index("link", ".", 1)).join(full, "link", "left").join(base, "base", "left").join(host, "host", "left").join(descriptor, ["host", "service"], "left")
    return found.select("link", F.coalesce("by_full", "by_base", "by_host", "by_descriptor", F.lit("")).alias("instance"))


def dataflow(edges: DataFrame, evidence: DataFrame, templates: DataFrame) -> DataFrame:
    """(container, table, relation_type, source): by evidence first, then by template; one row per container and table."""
    by_evidence = evidence.join(edges, "edge_id").select(F.substring_index("evidence_ref", ":", 1).alias("container"), F.col("dst_table").alias("table"), "relation_type", F.lit("evidence").alias("source"), F.lit(0).alias("way"))
    by_template = templates.select("container", "table", F.lit("TEMPLATE").alias("relation_type"), F.lit("template").alias("source"), F.lit(1).alias("way"))
    order = Window.partitionBy("container", "table").orderBy("way", "relation_type")
    return by_evidence.unionByName(by_template).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "way")


def equal_pairs(statements: DataFrame) -> DataFrame:
    """(template_id, src_table, dst_table, relation_type) from SQL text by patterns: write targets with their sources,
    and join and where equalities through their aliases. A parser's exactness is not the aim; see the README."""
    sql = F.regexp_replace(text.preprocessed_sql(F.col("sql_text")), r"\s+", " ")
    base = statements.select("template_id", sql.alias("sql"))
    names = r"([A-Za-z_][\w.]*)"
    tabled = base.select(
        "template_id", "sql",
        F.regexp_extract("sql", rf"(?i)\b(?:insert\s+into|update|merge\s+into|delete\s+from|create\s+table)\s+{names}", 1).alias("target"),
        F.regexp_extract("sql", r"(?i)^\s*(insert|update|merge|delete|create)", 1).alias("verb"),
        F.regexp_extract_all("sql", F.lit(r"(?i)\b(?:from|join|using)\s+([^()]*?)(?=\s+(?:where|on|join|inner|left|right|full|group|order|union|set|when|using)\b|\s*\)|$)"), F.lit(1)).alias("sources"),
        F.regexp_extract_all("sql", F.lit(r"[A-Za-z_]\w*\.[A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*\.[A-Za-z_]\w*"), F.lit(0)).alias("equalities"),
    )
    part = F.btrim(F.regexp_replace("source", r"(?i)\s+as\s+", " "))
    sources = tabled.select("template_id", F.explode(F.flatten(F.transform("sources", lambda x: F.split(x, ",")))).alias("source")).select(
        "template_id", F.upper(F.element_at(F.split(part, " "), 1)).alias("table"), F.upper(F.element_at(F.split(part, " "), -1)).alias("alias")
    ).filter("table <> 'DUAL'").distinct().hint("merge")  # exploded rows are many times the bytes that Spark takes them for
    written = tabled.filter("target <> ''").select("template_id", F.upper("target").alias("dst_table"), F.when(F.lower("verb").isin("insert", "create"), "INSERT_SELECT").otherwise(F.upper("verb")).alias("relation_type"))
    writes = written.join(sources, "template_id").filter("table <> dst_table").select("template_id", F.col("table").alias("src_table"), "dst_table", "relation_type")
    sides = tabled.select("template_id", "sql", F.explode("equalities").alias("eq")).select(
        "template_id", F.upper(F.regexp_extract("eq", r"^(\w+)\.", 1)).alias("left_alias"), F.upper(F.regexp_extract("eq", r"=\s*(\w+)\.", 1)).alias("right_alias"),
        F.when(F.col("sql").rlike(r"(?i)\bjoin\b"), "JOIN").otherwise("WHERE_EQ").alias("relation_type"),
    )
    left, right = sources.select("template_id", F.col("alias").alias("left_alias"), F.col("table").alias("lt")), sources.select("template_id", F.col("alias").alias("right_alias"), F.col("table").alias("rt"))
    joins = sides.join(left, ["template_id", "left_alias"]).join(right, ["template_id", "right_alias"]).filter("lt <> rt")
    pairs = joins.select("template_id", F.least("lt", "rt").alias("src_table"), F.greatest("lt", "rt").alias("dst_table"), "relation_type")
    return writes.unionByName(pairs).distinct()


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """Pairs of tables from constraints(name, table, type, r_name): type R against the constraint it names."""
    c, p = constraints.alias("c"), constraints.alias("p")
    return c.filter("type = 'R'").join(p, F.col("c.r_name") == F.col("p.name")).select(F.col("c.table").alias("child"), F.col("p.table").alias("parent"))
