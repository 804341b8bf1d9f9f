"""Evidence from sources and edges: configuration references, table candidates, identification, capped judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import lineage, scopes, search
from evidentia.session import stored

# What refers to a configuration key in Java.
VALUE_ANNOTATIONS = ("Value",)
PREFIX_ANNOTATIONS = ("ConfigurationProperties",)
CONFIG_METHODS = ("getProperty", "getParam", "getString", "getProperties", "getConfig")

# The source label of each bridge's evidence.
FIXED_LABELS = {"code_search": "jdt-ls-workspaceSymbol", "llm_rerank": "llm-rerank", "rag": "rag-cross-encoder"}
RECOVERY_LABELS = {"literal": "lp-sql-recover-literal", "sql_file": "lp-sql-recover-literal", "concat": "lp-java-extract-concat", "string_builder": "lp-java-extract-builder", "mybatis_mapper": "lp-mybatis-mapper2sql"}
STRATEGY_LABELS = {
    "exact_match": "lp-bind-resolver-exact", "annotation_prefix_match": "lp-bind-resolver-prefix", "hierarchical_match": "lp-bind-resolver-prefix", "xml_id_match": "lp-bind-resolver-prefix",
    "class_hint_exact": "lp-bind-resolver-prefix", "class_hint_package": "lp-bind-resolver-prefix", "semgrep_rule": "lp-bind-resolver-semgrep-rule", "ripgrep_fallback": "ripgrep-config-fallback", "source_file": "ripgrep-config-fallback",
}

# The signals of each dimension that may be shown to a model.
SIGNALS = {
    "method": ("name_match_strength", "call_distance_from_seed", "call_direction", "capability_match", "binding_source"),
    "sql": ("relation_type", "lineage_type", "src", "dst", "sql_template_id", "evidence_count", "recovery_mode"),
    "config": ("entity_key", "entity_type", "source_type", "bind_type", "bind_target", "bind_strategy", "value_type", "is_sensitive"),
}


def config_references(files: DataFrame, framework: tuple[str, ...] = ()) -> DataFrame:
    """(path, ref_key, ref_type, line, class_fqn, confidence) of what refers to configuration keys in Java files.

    Annotations with a string (of a value, of a prefix, of a framework) and calls of a property reader with one. The
    class is the innermost declared above the line, or for an annotation on a class the one declared next. Files are
    read line by line, so an argument on another line than its name is not seen.
    """
    prefilter = "@|" + "|".join(CONFIG_METHODS)
    package = F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    lines = files.filter(F.col("content").rlike(prefilter)).select("path", package.alias("package"), F.posexplode(F.split("content", "\n")).alias("line", "code"))
    declared = F.nullif(F.regexp_extract("code", r"\b(?:class|interface|enum)\s+(\w+)", 1), F.lit(""))
    order = Window.partitionBy("path").orderBy("line")
    above = F.last(declared, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(declared, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    names = "|".join(VALUE_ANNOTATIONS + PREFIX_ANNOTATIONS + framework)
    calls = "|".join(CONFIG_METHODS)
    shape = rf'(?:@(?:\w+\.)*(?:{names})|\b(?:{calls}))\s*\([^"()]*"[^"]*"'
    owned = lines.withColumns({"above": above, "below": below})  # over all lines, before those without a find go
    placed = owned.select("path", "package", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("code", F.lit(shape), F.lit(0))).alias("found"), "above", "below", F.col("code").rlike(r"^\s*@").alias("on_line"))
    name = F.regexp_extract("found", r"(\w+)\s*\(", 1)
    kind = F.when(name.isin(*VALUE_ANNOTATIONS), "annotation_value").when(name.isin(*PREFIX_ANNOTATIONS), "annotation_prefix").when(name.isin(*CONFIG_METHODS), "method_arg").otherwise("annotation")
    owner = F.when((kind == "annotation_prefix") & F.col("on_line"), F.coalesce("below", "above")).otherwise(F.coalesce("above", "below"))
    key = text.normalised_key(F.regexp_extract("found", '"([^"]*)"', 1))
    return placed.select("path", key.alias("ref_key"), kind.alias("ref_type"), "line", text.canonical(F.col("package"), owner).alias("class_fqn"), F.when(kind == "method_arg", "medium").otherwise("high").alias("confidence"))


def table_candidates(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, table, evidence_count, n_edges): tables of edges whose name holds the term or is held by it, upper case.

    Edges are summed by table before anything meets, and names meet in both directions by their rarest piece.
    """
    ends = edges.select(F.explode(F.array("src_table", "dst_table")).alias("table"), "evidence_count").filter("coalesce(table, '') <> ''")
    tables = ends.groupBy("table").agg(F.sum("evidence_count").alias("evidence_count"), F.count("*").alias("n_edges")).withColumn("__name", F.upper("table"))
    asked = terms.select("term").distinct().withColumn("__term", F.upper("term"))
    names, words = tables.select("__name"), asked.select("__term")
    down = search.contained(words.toDF("needle"), names.toDF("text")).toDF("__term", "__name")
    up = search.contained(names.toDF("needle"), words.toDF("text")).toDF("__name", "__term")
    pairs = down.unionByName(up).distinct()
    return pairs.join(asked, "__term").join(tables, "__name").select("term", "table", "evidence_count", "n_edges")


def code_of_tables(wanted: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(table, source_file): files whose evidence stands behind an edge at each wanted(table), either end."""
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("src_table", "dst_table"))).alias("table"))
    near = ends.join(wanted.select("table").distinct(), "table").join(evidence, "edge_id")
    return near.select("table", F.substring_index("evidence_ref", ":", 1).alias("source_file")).filter("coalesce(source_file, '') <> ''").distinct()


def backfilled_owners(edges: DataFrame, evidence: DataFrame, datasources: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(edge_id, module, src_owner, src_how, dst_owner, dst_how) of edges with an end without owner, for each module with
    evidence and a datasource: the synonym's owner of the datasource's user, else that user, else to be reviewed."""
    bare = edges.filter("src_owner = '' or dst_owner = ''")
    modules = evidence.select("edge_id", F.substring_index("evidence_ref", "/", 1).alias("module")).filter("module <> ''").distinct()
    placed = bare.join(modules, "edge_id").join(datasources.select("module", F.upper("user").alias("user")), "module")
    out = placed
    for side in ("src", "dst"):
        known = synonyms.select(F.upper("owner").alias("user"), F.upper("synonym").alias("__name"), F.col("table_owner").alias(f"__{side}"))
        out = out.withColumn("__name", F.upper(f"{side}_table")).join(known, ["user", "__name"], "left").drop("__name")
    owner = lambda side: F.when(F.col(f"{side}_owner") != "", F.col(f"{side}_owner")).otherwise(F.coalesce(f"__{side}", "user"))
    how = lambda side: F.when(F.col(f"{side}_owner") != "", "static").when(F.col(f"__{side}").isNotNull(), "synonym").when(F.col("user") != "", "direct").otherwise("needs_review")
    return out.select("edge_id", "module", owner("src").alias("src_owner"), how("src").alias("src_how"), owner("dst").alias("dst_owner"), how("dst").alias("dst_how"))


def path_signals(tables: DataFrame, lines: DataFrame, name_patterns: list[str], rule_columns: list[str], exact: list[str], folded: list[str]) -> DataFrame:
    """(table, rule_columns_hit, a, b, c, d): what speaks for tables(table, columns, comment) holding configuration.

    a: a pattern in the name or two rule columns; b: a signal word in the comment; c and d: a line of lines(corpus,
    line) that holds the table's name and a signal word, in business or dictionary documents (c) or the customer's
    dictionary (d). Lines are cut into words, which meet the names by equality.
    """
    name = F.upper("table")
    named = F.exists(F.array(*map(F.lit, name_patterns)), lambda p: F.contains(name, F.upper(p)))
    rules = F.size(F.array_intersect(F.transform("columns", F.upper), F.array(*[F.lit(c.upper()) for c in rule_columns])))
    told = lines.filter(text.has_signal(F.col("line"), exact, folded)).select("corpus", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("line"), F.lit("[A-Z0-9_$#]+"), F.lit(0)))).alias("__name"))
    hits = told.join(tables.select(name.alias("__name")).distinct(), "__name").groupBy("__name").agg(F.bool_or(F.col("corpus").isin("business_docs", "dict_docs")).alias("c"), F.bool_or(F.col("corpus") == "customer_dict").alias("d"))
    score = lambda x: F.when(x, 1.0).otherwise(0.0)
    found = tables.withColumn("__name", name).join(hits, "__name", "left")
    return found.select("table", rules.alias("rule_columns_hit"), score(named | (rules >= 2)).alias("a"), score(text.has_signal(F.col("comment"), exact, folded)).alias("b"), score(F.coalesce("c", F.lit(False))).alias("c"), score(F.coalesce("d", F.lit(False))).alias("d"))


def rule_sets(tables: DataFrame, rule_columns: list[str], categories: dict[str, str]) -> DataFrame:
    """(table, category, rule_columns_hit) of tables with two rule columns at least; the first category whose pattern
    the name holds, '' for none."""
    hit = F.size(F.array_intersect(F.transform("columns", F.upper), F.array(*[F.lit(c.upper()) for c in rule_columns])))
    category = F.coalesce(*[F.when(F.contains(F.upper("table"), F.lit(p.upper())), F.lit(c)) for p, c in categories.items()], F.lit(""))
    return tables.select("table", category.alias("category"), hit.alias("rule_columns_hit")).filter("rule_columns_hit >= 2")


def judged(candidates: DataFrame, caps: dict[str, int], order: list[str | Column]) -> DataFrame:
    """Adds status: '' for the first so many candidates of each dimension, cap_skipped for the others, which stay, and
    unsupported_kind for candidates of no dimension."""
    cap = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(n)) for d, n in caps.items()])
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))
    return candidates.withColumn("status", F.when(cap.isNull(), "unsupported_kind").when(place > cap, "cap_skipped").otherwise(""))


def evidence_label(worker: Column, recovery: Column, strategy: Column) -> Column:
    """The source label of a bridge's evidence: fixed, or by how SQL was recovered or a key was bound."""
    of = lambda col, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[col]
    return F.coalesce(of(worker, FIXED_LABELS), F.when(worker == "db", of(recovery, RECOVERY_LABELS)).when(worker == "config", of(strategy, STRATEGY_LABELS)))


def shown_signals(signals: Column, dimension: str) -> Column:
    """The entries of a map of signals that may be shown for a dimension."""
    return F.map_filter(signals, lambda k, _: k.isin(*SIGNALS[dimension]))


def unresolved_ratio(calls: DataFrame, resolved: str = "resolved") -> DataFrame:
    """(ratio,): share of rows that are not resolved; 0 without rows."""
    return calls.agg(F.coalesce(F.avg(F.when(F.col(resolved).cast("int") == 1, 0.0).otherwise(1.0)), F.lit(0.0)).alias("ratio"))


def real_tables(statements: DataFrame) -> DataFrame:
    """(template_id, table): tables that a statement names in any scope, without the names that its WITH clauses give."""
    return scopes.tables_read(statements).select("template_id", "table").distinct()


def subquery_relations(statements: DataFrame) -> DataFrame:
    """(template_id, src_table, dst_table, relation_type): tables of nested queries and those of the query around them."""
    return scopes.nested_relations(statements).filter("src_table <> dst_table").select("template_id", "src_table", "dst_table", "relation_type").distinct()


def recovered_statements(scripts: DataFrame, least: int = 10) -> DataFrame:
    """(path, place, sql) of SQL scripts: parts between semicolons without comments and SQL*Plus commands, that are long
    enough and hold a verb."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    bare = F.regexp_replace(bare, r"(?im)^\s*(?:set|prompt|spool|whenever|define|undefine|exit|quit|connect|show|rem|column|@@?)\b[^\n]*$|^\s*/\s*$", " ")
    parts = scripts.select("path", F.posexplode(F.split(bare, ";")).alias("place", "part"))
    sql = F.btrim(F.regexp_replace("part", r"\s+", " "))
    return parts.select("path", "place", sql.alias("sql")).filter((F.length("sql") >= least) & F.col("sql").rlike(r"(?i)\b(select|insert|update|delete|merge|create)\b"))


def owners(objects: DataFrame, excluded: list[str]) -> DataFrame:
    """(owner,): owners of any object in upper case, without those that a glob excludes. No owner at all is an
    error when the rows are read, as an empty list would wipe what is known."""
    globs = [p.upper().replace("\\", "\\\\").replace(".", r"\.").replace("$", r"\$").replace("*", ".*").replace("?", ".") for p in excluded]
    found = objects.select(F.upper("owner").alias("owner")).filter("coalesce(owner, '') <> ''").distinct()
    kept = found.filter(~F.col("owner").rlike("^(?:" + "|".join(globs or ["(?!)"]) + ")$"))
    counted = kept.agg(F.collect_set("owner").alias("all"))  # owners are few: schemas of a database
    return counted.select(F.explode(F.when(F.size("all") == 0, F.raise_error(F.lit("no owner is left")).cast("array<string>")).otherwise(F.col("all"))).alias("owner"))


def sheet_evidence(records: DataFrame) -> DataFrame:
    """(id, kind, target, change_type) of historical records(function_name, function_type, notes, tables): one item for a
    function, one for each table."""
    name = F.regexp_replace("function_name", "[^a-zA-Z0-9_]", "-")
    kind = F.lower("function_type")
    changed = F.when(F.contains("notes", F.lit("改")) | F.contains(F.lower("notes"), F.lit("modify")), "MODIFY").otherwise("NEW")
    own = records.filter("coalesce(function_name, '') <> ''").select(F.concat_ws("-", F.lit("fpa"), kind, F.substring(name, 1, 40)).alias("id"), F.lit("INTERFACE").alias("kind"), F.col("function_name").alias("target"), changed.alias("change_type"))
    by_table = records.select(F.explode("tables").alias("target"), kind.alias("k"), F.substring(name, 1, 30).alias("n"))
    return own.unionByName(by_table.select(F.concat(F.lit("fpa-table-"), "target", F.lit("-from-"), "k", F.lit("-"), "n").alias("id"), F.lit("SQL_TABLE").alias("kind"), "target", F.lit("DB").alias("change_type")))


def held_out_away(records: DataFrame, held_out: DataFrame, key: str = "requirement_id") -> DataFrame:
    """Records whose requirement is not held out."""
    return records.join(held_out.select(key).distinct(), key, "left_anti")


def scoped_votes(samples: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each key in a random order that a seed fixes: what is sampled for a vote."""
    return samples.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *samples.columns)))).filter(F.col("__n") <= n).drop("__n")


def indexed_rows(rows: DataFrame, names: dict[str, tuple[str, ...]], keys: list[str], counted_from_zero: tuple[str, ...] = ()) -> DataFrame:
    """Indexer rows (camel or snake case) as a table: each column is the first of its names that the rows have, names get
    dots for #, lines count from 0 (missing ones are 0), rows without the first key are left out and equal keys stay once."""
    has = lambda options: next((F.col(n) for n in options if n in rows.columns), F.lit(None).cast("string"))
    cols = []
    for name, options in names.items():
        col = has(options)
        if name in counted_from_zero:
            col = F.greatest(col.cast("int") - 1, F.lit(0))
        elif name.endswith("_fqn"):
            col = F.replace(col, F.lit("#"), F.lit("."))
        cols.append(col.alias(name))
    return rows.select(*cols).filter(F.coalesce(keys[0], F.lit("")) != "").dropDuplicates(keys)


# The row sets of an index besides methods, and the names their fields may have.
ROW_SETS: dict[str, tuple[dict[str, tuple[str, ...]], list[str]]] = {
    "classes": ({"class_fqn": ("classFqn", "class_fqn"), "kind": ("kind",), "source_file": ("sourceFile", "source_file"), "start_line": ("startLine", "start_line"), "end_line": ("endLine", "end_line")}, ["class_fqn", "source_file"]),
    "fields": ({"field_fqn": ("fieldFqn", "field_fqn"), "type": ("type",), "source_file": ("sourceFile", "source_file"), "start_line": ("startLine", "start_line")}, ["field_fqn", "source_file"]),
    "calls": ({"caller_fqn": ("callerMethodFqn", "caller_method_fqn"), "callee_fqn": ("calleeMethodFqn", "callee_method_fqn"), "resolved": ("resolved",), "start_line": ("lineNo", "line_no")}, ["caller_fqn", "callee_fqn", "start_line"]),
    "inheritance": ({"child_fqn": ("childFqn", "child_fqn"), "parent_fqn": ("parentFqn", "parent_fqn"), "relation": ("relation",)}, ["child_fqn", "parent_fqn", "relation"]),
    "references": ({"symbol_fqn": ("symbolFqn", "symbol_fqn"), "source_file": ("sourceFile", "source_file"), "start_line": ("lineNo", "line_no")}, ["symbol_fqn", "source_file", "start_line"]),
    "table_refs": ({"method_fqn": ("methodFqn", "method_fqn"), "table": ("tableName", "table_name")}, ["method_fqn", "table"]),
}


def index_table(rows: DataFrame, kind: str) -> DataFrame:
    """One of ROW_SETS from indexer rows."""
    names, keys = ROW_SETS[kind]
    return indexed_rows(rows, names, keys, ("start_line", "end_line"))


def mapper_ingest(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, edges) of mapper statements(path, statement, verb, sql): a template for each with a well-formed name,
    and the edges between tables that its text tells."""
    kept = statements.filter(F.col("statement").rlike(text.FQN_FORM))
    templates = kept.select(F.concat(F.lit("T"), F.upper(F.substring(F.md5(F.concat_ws(":", "path", "statement")), 1, 12))).alias("template_id"), F.col("path").alias("source_file"), F.col("statement").alias("container"), F.col("sql").alias("sql_text"), F.lit("mybatis_mapper").alias("recovery_mode"))
    templates = stored(templates)  # read by four joins
    pairs = lineage.equal_pairs(templates).unionByName(subquery_relations(templates))
    named = pairs.join(templates.select("template_id", "source_file", "container").hint("merge"), "template_id")
    return templates, named.select(lineage.edge_id(F.col("src_table"), F.col("dst_table"), F.col("relation_type")).alias("edge_id"), "src_table", "dst_table", "relation_type", "container", "source_file").distinct()
