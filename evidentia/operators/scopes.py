"""Statements as tables: tokens with their scopes, what each scope reads, and the relations and columns that follow.

A statement becomes one row a token. Brackets are matched by running sums and the last opening bracket of a depth; a
bracket that holds a query opens a scope, any other one belongs to the scope around it. All windows are by statement, so
one shuffle by template_id deals out all the work. Partitions are as many as the text's bytes ask for, there and in the joins
that follow, so that the tokens that a task sorts do not grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.session import checkpointed, met, parts_for

#: Literals, quoted and dotted names with an optional link, numbers, comparisons, single signs.
TOKEN = r"""'(?:[^']|'')*'|(?::?[A-Za-z_][\w$#]*|"[^"]*")(?:\s*\.\s*(?:[A-Za-z_][\w$#]*|"[^"]*"|\*))*(?:@[\w.]+)?|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||[^\s\w]"""
COMMENTS = r"('(?:[^']|'')*')|(?s:/\*.*?\*/)|--[^\n]*"
#: Words that are never tables, aliases or columns.
RESERVED = tuple(
    "DUAL SELECT FROM WHERE JOIN LEFT RIGHT FULL CROSS INNER OUTER NATURAL ON USING AND OR NOT IN EXISTS BETWEEN LIKE IS NULL CASE WHEN THEN ELSE END AS GROUP ORDER BY HAVING UNION ALL "
    "EXCEPT INTERSECT MINUS INSERT INTO VALUES UPDATE SET DELETE MERGE CREATE ALTER DROP TABLE INDEX VIEW WITH RECURSIVE DISTINCT FOR LIMIT OFFSET FETCH CONNECT START PRIOR LATERAL MATCHED RETURNING ASC DESC ANY SOME OVER PARTITION".split()
)
SET_OPERATORS = ("UNION", "EXCEPT", "INTERSECT", "MINUS")
CLAUSES = ("WITH", "SELECT", "FROM", "ON", "WHERE", "GROUP", "ORDER", "HAVING", "SET", "VALUES", "CONNECT", "START", "USING")
WRITES = {"INSERT": "INSERT_SELECT", "UPDATE": "UPDATE_FROM", "DELETE": "DELETE_FROM", "MERGE": "MERGE", "CREATE": "INSERT_SELECT"}
SCOPE = ("template_id", "scope", "core")


def by_place(*keys: str) -> WindowSpec:
    """Rows of a statement (and keys) in the order of their tokens."""
    return Window.partitionBy("template_id", *keys).orderBy("pos")


def is_name(token: Column) -> Column:
    return token.rlike(r'^[A-Z_"]') & ~token.isin(*RESERVED)


def last_part(name: Column) -> Column:
    return F.replace(F.btrim(F.element_at(F.split(F.substring_index(name, "@", 1), r"\s*\.\s*"), -1)), F.lit('"'), F.lit(""))


def part_before(name: Column) -> Column:
    """The part before the last one, '' if there is none."""
    parts = F.split(F.substring_index(name, "@", 1), r"\s*\.\s*")
    return F.replace(F.btrim(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")), F.lit('"'), F.lit(""))


def tokens(statements: DataFrame) -> DataFrame:
    """(template_id, pos, token, scope, core, flat, clause) of statements(template_id, sql_text).

    scope is the place of the bracket that opens the query, -1 for the statement; core counts the queries that set
    operators part; flat tokens stand directly in their scope and not in a bracket of a call or list within it; clause
    is the keyword that governs the token. Tokens but literals are in upper case. Null and blank statements have none.
    """
    bare = F.regexp_replace("sql_text", COMMENTS, "$1 ")
    marked = F.regexp_replace(text.preprocessed_sql(F.regexp_replace(bare, r"\(\s*\+\s*\)|@[\w.]+", " ")), r"\?", ":p")
    dealt = statements.repartition(parts_for(statements, "sql_text"), "template_id")
    found = dealt.select("template_id", F.posexplode(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))).alias("pos", "raw"))
    token = found.select("template_id", "pos", F.when(F.substring("raw", 1, 1) == "'", F.col("raw")).otherwise(F.upper("raw")).alias("token"))

    opens, closes = (F.col("token") == "(").cast("int"), (F.col("token") == ")").cast("int")
    depth = F.sum(opens - closes).over(by_place())
    ahead = F.lead("token").over(by_place())
    # a bracket as a token of what is around it, at `level`; what it holds is at `inner`
    leveled = token.withColumns({"level": depth - opens, "inner": F.when(opens + closes > 0, depth - opens + 1), "query": (opens == 1) & ahead.isin("SELECT", "WITH")})
    opener = F.last(F.when(F.col("token") == "(", F.col("query")), ignorenulls=True).over(by_place("inner"))
    stepped = leveled.withColumn("step", F.when(F.col("query"), 1).when((F.col("token") == ")") & opener, -1).otherwise(0))
    nested = stepped.withColumn("around", F.sum("step").over(by_place()) - F.col("query").cast("int"))
    # each opening bracket also stands at the depth that it opens, where the tokens behind it find it as the last one
    own = F.struct(F.col("around").alias("at"), F.lit(None).cast("struct<place:int,level:bigint>").alias("opened"))
    inside = F.struct((F.col("around") + 1).alias("at"), F.struct(F.col("pos").alias("place"), (F.col("level") + 1).alias("level")).alias("opened"))
    doubled = nested.withColumn("x", F.explode(F.when(F.col("query"), F.array(own, inside)).otherwise(F.array(own)))).select("template_id", "pos", "token", "level", "x.at", "x.opened")
    scope = F.last("opened", ignorenulls=True).over(by_place("at"))
    scoped = doubled.withColumn("s", scope).filter("opened is null").select("template_id", "pos", "token", F.coalesce("s.place", F.lit(-1)).alias("scope"), (F.col("level") == F.coalesce("s.level", F.lit(0))).alias("flat"))

    cored = scoped.withColumn("core", F.sum((F.col("flat") & F.col("token").isin(*SET_OPERATORS)).cast("int")).over(by_place("scope")))
    clause = F.last(F.when(F.col("flat") & F.col("token").isin(*CLAUSES), F.col("token")), ignorenulls=True).over(by_place("scope", "core"))
    return cored.withColumn("clause", F.coalesce(clause, F.lit("")))


def with_leads(toks: DataFrame, n: int = 5) -> DataFrame:
    """Flat tokens with the next n flat ones of their scope as t1.., and the places of the brackets among these."""
    w = by_place("scope", "core")
    flat = toks.filter("flat")
    return flat.withColumns({f"t{i}": F.lead("token", i).over(w) for i in range(1, n + 1)} | {f"p{i}": F.lead("pos", i).over(w) for i in (1, 3, 5)} | {"behind": F.lag("token").over(w)})


def parts_of(toks: DataFrame) -> int:
    """In how many partitions tokens (checkpointed ones) are."""
    return toks.rdd.getNumPartitions()


def references(toks: DataFrame) -> DataFrame:
    """(template_id, scope, core, pos, alias, schema, name, inner, target, verb): what each scope reads or writes.

    A table has its name and schema ('' if none is told) and no inner; a derived table and a name of a WITH clause have
    the scope of their query as inner. target marks the table that the statement writes.
    """
    verb = F.first("token").over(by_place())
    led = with_leads(toks.withColumn("verb", verb))
    derived = F.col("t1") == "("
    at_start = (F.col("scope") == -1) & F.col("behind").isNull()
    writes = (F.col("token") == "INTO") & F.col("verb").isin("INSERT", "MERGE", "WITH") | (F.col("token").isin("UPDATE", "DELETE") & at_start) | ((F.col("token") == "TABLE") & (F.col("verb") == "CREATE") & (F.col("scope") == -1))
    reads = F.col("token").isin("FROM", "JOIN") | ((F.col("token") == "USING") & (F.col("verb") == "MERGE")) | ((F.col("token") == ",") & F.col("clause").isin("FROM", "ON"))
    deletes = (F.col("token") == "FROM") & (F.col("verb") == "DELETE") & (F.col("scope") == -1) & (F.col("behind") == "DELETE")
    named = led.filter((writes | reads) & (is_name(F.col("t1")) | derived))
    behind = lambda a, b: F.when(F.col(a) == "AS", F.col(b)).otherwise(F.col(a))
    alias = F.when(derived, F.when(F.col("t2") == ")", behind("t3", "t4"))).otherwise(behind("t2", "t3"))
    found = named.select(*SCOPE, "pos", "verb", F.when(is_name(alias), last_part(alias)).alias("given"), F.when(~derived, F.col("t1")).alias("full"), F.when(derived, F.col("p1")).alias("derived"), (writes | deletes).alias("target"))
    ctes = with_names(led)
    bare = F.when(part_before(F.col("full")) == "", last_part(F.col("full")))
    parts = parts_of(toks)
    known = met(parts, found.withColumn("name", bare), ctes, ["template_id", "name"], "left").repartition(parts, "template_id")
    # of several queries of one name the last one before the reference counts; a WITH clause may not name what is written
    best = known.withColumn("n", F.row_number().over(Window.partitionBy("template_id", "pos").orderBy(F.desc_nulls_last(F.when(F.col("body") < F.col("pos"), F.col("body"))), F.desc_nulls_last("body")))).filter("n = 1")
    inner = F.coalesce("derived", F.when(~F.col("target"), F.col("body")))
    is_table = inner.isNull()
    out = best.select(*SCOPE, "pos", F.coalesce("given", last_part(F.col("full"))).alias("alias"), F.when(is_table, part_before(F.col("full"))).otherwise("").alias("schema"), F.when(is_table, last_part(F.col("full"))).alias("name"), inner.alias("inner"), "target", "verb")
    return out.filter("name is not null or inner is not null")


def with_names(led: DataFrame) -> DataFrame:
    """(template_id, name, body): names that WITH clauses give, and the scopes of their queries."""
    starts = (F.col("clause") == "WITH") & F.col("token").isin("WITH", "RECURSIVE", ",") & is_name(F.col("t1"))
    plain, listed = (F.col("t2") == "AS") & (F.col("t3") == "("), (F.col("t2") == "(") & (F.col("t4") == "AS") & (F.col("t5") == "(")
    return led.filter(starts & (plain | listed)).select("template_id", last_part(F.col("t1")).alias("name"), F.when(plain, F.col("p3")).otherwise(F.col("p5")).alias("body"))


def scope_ways(toks: DataFrame) -> DataFrame:
    """(template_id, scope, way): the scopes around each one, itself first; put together along the statement's brackets."""
    parts = parts_of(toks)
    opened = met(parts, toks.filter("token = '('"), toks.select("template_id", F.col("scope").alias("pos")).repartition(parts, "template_id").distinct(), ["template_id", "pos"]).repartition(parts, "template_id")
    listed = opened.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("place"), F.col("scope").alias("around")))).alias("all"))
    first = F.map_from_arrays(F.array(F.lit(-1)), F.array(F.array(F.lit(-1))))
    ways = F.aggregate("all", first, lambda known, x: F.map_concat(known, F.map_from_arrays(F.array(x["place"]), F.array(F.concat(F.array(x["place"]), known[x["around"]])))))
    whole = met(parts, toks.select("template_id").repartition(parts, "template_id").distinct(), listed, ["template_id"], "left").select("template_id", F.explode(F.coalesce(F.when(F.col("all").isNotNull(), ways), first)).alias("scope", "way"))
    return whole


def tables_read(statements: DataFrame) -> DataFrame:
    """(template_id, schema, table): the tables that a statement names, of any scope, each once."""
    return references(checkpointed(tokens(statements))).filter("name is not null").select("template_id", "schema", F.col("name").alias("table")).distinct()


def select_items(toks: DataFrame) -> DataFrame:
    """(template_id, scope, core, item, out, qualifier, col): the columns that each item of a SELECT list is made of.

    out is the item's name, '*' for all columns; qualifier is '' for a bare column. A column list behind a WITH name does
    not rename.
    """
    listed = toks.filter("clause = 'SELECT' and not (flat and token in ('SELECT', 'DISTINCT', 'ALL'))")
    w = by_place("scope", "core")
    numbered = listed.withColumns({"item": F.sum((F.col("flat") & (F.col("token") == ",")).cast("int")).over(w), "after": F.lead("token").over(w), "before": F.lag("token").over(w)}).filter("not (flat and token = ',')")
    ends = Window.partitionBy(*SCOPE, "item")
    marked = numbered.withColumns({"last": F.col("pos") == F.max("pos").over(ends), "first": F.col("pos") == F.min("pos").over(ends)})
    named = F.col("last") & ~F.col("first") & is_name(F.col("token")) & (F.col("before").isin("AS", ")", "END") | F.col("before").rlike(r"""^['"\w]""")) & ~F.col("before").isin("DISTINCT", "SELECT")
    out = F.max(F.when(F.col("last") & (is_name(F.col("token")) | F.col("token").isin("*")), last_part(F.col("token")))).over(ends)
    source = (is_name(F.col("token")) | ((F.col("token") == "*") & F.col("first"))) & ~named & (F.coalesce("after", F.lit("")) != "(")
    return marked.withColumn("out", out).filter(source).select(*SCOPE, "item", "out", part_before(F.col("token")).alias("qualifier"), last_part(F.col("token")).alias("col"))


def equalities(toks: DataFrame) -> DataFrame:
    """(template_id, scope, pos, kind, lq, lc, rq, rc): column = column in ON clauses, and in WHERE clauses of the statement
    itself; of nested queries' WHERE clauses none."""
    w = by_place()
    seen = toks.withColumns({"l": F.lag("token").over(w), "r": F.lead("token").over(w), "l2": F.lag("token", 2).over(w), "r2": F.lead("token", 2).over(w)})
    arithmetic = ("+", "-", "*", "/", "||", "(")
    kept = seen.filter((F.col("token") == "=") & is_name(F.col("l")) & is_name(F.col("r")) & ~F.coalesce("r2", F.lit("")).isin(*arithmetic) & ~F.coalesce("l2", F.lit("")).isin(*arithmetic[:-1]))
    kind = F.when(F.col("clause") == "ON", "JOIN").when((F.col("clause") == "WHERE") & (F.col("scope") == -1), "WHERE_EQ")
    return kept.select(*SCOPE, "pos", kind.alias("kind"), part_before(F.col("l")).alias("lq"), last_part(F.col("l")).alias("lc"), part_before(F.col("r")).alias("rq"), last_part(F.col("r")).alias("rc")).filter("kind is not null and lq <> '' and rq <> ''")


def origins(columns: DataFrame, toks: DataFrame, refs: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(key, schema, table, col): the tables' columns behind columns(template_id, key, scope, core, qualifier, col).

    A qualifier means the nearest reference of that alias, outward from its scope; a bare column the only reference of
    its own scope. Columns of derived tables and WITH names are followed through their SELECT lists, round by round,
    until all are columns of tables; a query that reads itself is followed once. Rounds are as many as queries are nested
    (or most_rounds), each joins what is still open only, and what it leaves is checkpointed.
    """
    parts = parts_of(toks)
    ways, items = checkpointed(scope_ways(toks)), checkpointed(select_items(toks))
    placed = refs.filter("not target or verb in ('UPDATE', 'DELETE', 'MERGE')").select("template_id", F.col("scope").alias("there"), F.col("core").alias("there_core"), "alias", "schema", "name", "inner", F.col("pos").alias("ref"))
    alone = placed.repartition(parts, "template_id").groupBy("template_id", "there", "there_core").agg(F.count("*").alias("n"), F.min("alias").alias("only")).filter("n = 1").select("template_id", F.col("there").alias("scope"), F.col("there_core").alias("core"), "only")
    rank = Window.partitionBy("template_id", "key", "scope", "core", "qualifier", "col").orderBy("far", F.desc("same_core"), "ref")
    open_, done, seen, rounds = columns.select("template_id", "key", "scope", "core", "qualifier", "col").repartition(parts, "template_id").distinct(), None, None, 0
    open_ = checkpointed(open_)
    while not open_.isEmpty() and (most_rounds is None or rounds < most_rounds):
        owned = met(parts, open_, alone, ["template_id", "scope", "core"], "left").withColumn("alias", F.when(F.col("qualifier") == "", F.col("only")).otherwise(F.col("qualifier")))
        near = met(parts, met(parts, owned, ways, ["template_id", "scope"]), placed, ["template_id", "alias"]).withColumn("far", F.array_position("way", F.col("there"))).filter("far > 0").repartition(parts, "template_id")
        # within one scope the references of the same core come first; a scope around has the core that it stands in
        best = checkpointed(near.withColumn("same_core", (F.col("there") != F.col("scope")) | (F.col("there_core") == F.col("core"))).withColumn("n", F.row_number().over(rank)).filter("n = 1").select("template_id", "key", "schema", "name", "inner", "col"))
        tables = best.filter("name is not null").select("template_id", "key", "schema", F.col("name").alias("table"), "col")
        done = tables if done is None else done.unionByName(tables)
        inner = best.filter("name is null").select("template_id", "key", F.col("inner").alias("scope"), F.col("col").alias("wanted"))
        listed = met(parts, inner, items, ["template_id", "scope"]).filter("out = wanted or out = '*'").repartition(parts, "template_id")
        following = listed.select("template_id", "key", "scope", "core", "qualifier", F.when(F.col("col") == "*", F.col("wanted")).otherwise(F.col("col")).alias("col")).distinct()
        seen = open_ if seen is None else seen.unionByName(open_)
        open_ = met(parts, following, seen, ["template_id", "key", "scope", "core", "qualifier", "col"], "left_anti")
        open_ = checkpointed(open_)
        rounds += 1
    return (done if done is not None else columns.select("template_id", "key", F.lit("").alias("schema"), F.lit("").alias("table"), "col").limit(0)).repartition(parts, "template_id").distinct()


def relations(statements: DataFrame) -> DataFrame:
    """(template_id, src_schema, src_table, src_col, dst_schema, dst_table, dst_col, relation_type, lineage_type).

    Writes: every table that a statement reads, in any scope, into the one that it writes (INSERT_SELECT, also for CREATE
    TABLE AS, UPDATE_FROM, DELETE_FROM, MERGE). JOIN and WHERE_EQ: equal columns of two tables, followed through derived
    tables and WITH names. SUBQUERY and EXISTS: tables of nested queries to those of the outermost FROM clause, without
    these. A table is its schema and name; relations of a table with itself are left out. What is no SQL gives nothing.
    """
    toks = checkpointed(tokens(statements))
    parts = parts_of(toks)
    refs = checkpointed(references(toks))
    real = refs.filter("name is not null").select("template_id", "scope", "schema", "name", "target", "verb", "pos")
    target = real.filter("target").groupBy("template_id", "verb").agg(F.min_by(F.struct("schema", "name"), "pos").alias("t"))
    kind = F.coalesce(*[F.when(F.col("verb") == v, F.lit(k)) for v, k in WRITES.items()], F.lit("INSERT_SELECT"))
    pair = lambda a_schema, a, b_schema, b: (F.col(a_schema) != F.col(b_schema)) | (F.col(a) != F.col(b))
    none = F.lit("")
    written = met(parts, real, target.select("template_id", kind.alias("relation_type"), F.col("t.schema").alias("ts"), F.col("t.name").alias("tn")), ["template_id"]).filter(pair("schema", "name", "ts", "tn"))
    writes = written.select("template_id", F.col("schema").alias("src_schema"), F.col("name").alias("src_table"), none.alias("src_col"), F.col("ts").alias("dst_schema"), F.col("tn").alias("dst_table"), none.alias("dst_col"), "relation_type", F.lit("DIRECT").alias("lineage_type"))

    eq = equalities(toks)
    sides = eq.select("template_id", *SCOPE[1:], F.explode(F.array(F.struct(F.concat("pos", F.lit("l")).alias("key"), F.col("lq").alias("qualifier"), F.col("lc").alias("col")), F.struct(F.concat("pos", F.lit("r")).alias("key"), F.col("rq").alias("qualifier"), F.col("rc").alias("col")))).alias("x")).select(*SCOPE, "x.*")
    found = checkpointed(origins(sides, toks, refs))
    side = lambda end, to: found.filter(F.col("key").endswith(end)).select("template_id", F.expr("cast(substring(key, 1, length(key) - 1) as int)").alias("pos"), F.col("schema").alias(f"{to}_schema"), F.col("table").alias(f"{to}_table"), F.col("col").alias(f"{to}_col"))
    both = met(parts, eq.select("template_id", "pos", F.col("kind").alias("relation_type")), side("l", "src"), ["template_id", "pos"])
    equal = met(parts, both, side("r", "dst"), ["template_id", "pos"]).filter(pair("src_schema", "src_table", "dst_schema", "dst_table")).withColumn("lineage_type", F.lit("INDIRECT")).drop("pos")

    return writes.unionByName(equal).unionByName(_below(toks, refs)).repartition(parts, "template_id").distinct()


def nested_relations(statements: DataFrame) -> DataFrame:
    """The rows of relations() between nested queries and those around them (SUBQUERY, EXISTS), and no others. Statements
    without a bracket before a SELECT or WITH have none and are not cut into tokens."""
    behind = F.upper(F.expr("substring(sql_text, nullif(instr(sql_text, '('), 0))"))
    toks = checkpointed(tokens(statements.filter(F.contains(behind, F.lit("SELECT")) | F.contains(behind, F.lit("WITH")))))
    return _below(toks, checkpointed(references(toks))).repartition(parts_of(toks), "template_id").distinct()


def _below(toks: DataFrame, refs: DataFrame) -> DataFrame:
    """What nested_relations() says, of tokens and their references; rows may be repeated."""
    parts, none = parts_of(toks), F.lit("")
    real = refs.filter("name is not null").select("template_id", "scope", "schema", "name", "target", "verb", "pos")
    # nested queries that stand in an expression: not derived tables, not bodies of WITH names
    ways = checkpointed(scope_ways(toks))
    w = by_place()
    brackets = toks.withColumn("behind", F.lag("token").over(w)).filter("token = '('").select("template_id", F.col("pos").alias("sub"), "behind")
    bodies = refs.filter("inner is not null").select("template_id", F.col("inner").alias("sub")).distinct()
    subs = met(parts, met(parts, ways.filter("scope >= 0").select("template_id", F.col("scope").alias("sub")), bodies, ["template_id", "sub"], "left_anti"), brackets, ["template_id", "sub"])
    placed = checkpointed(met(parts, real, ways, ["template_id", "scope"]))
    inside = placed.select("template_id", F.explode("way").alias("sub"), "schema", "name")
    # the outermost FROM clause: of the scopes around least others the first
    depth = met(parts, refs.filter("not target or verb = 'DELETE'"), ways, ["template_id", "scope"]).repartition(parts, "template_id").select("template_id", F.struct(F.size("way").alias("depth"), "scope", "core").alias("at"))
    outermost = depth.groupBy("template_id").agg(F.min("at.depth").alias("depth"), F.min_by("at.scope", "at").alias("scope"))
    top = checkpointed(outermost.select("template_id", F.col("scope").alias("top")))
    from_there = met(parts, placed, top, ["template_id"])
    derived = met(parts, refs.filter("inner is not null").select("template_id", F.col("scope").alias("top"), F.col("inner").alias("d")), top, ["template_id", "top"]).groupBy("template_id").agg(F.collect_set("d").alias("ds"))
    outer = met(parts, from_there, derived, ["template_id"], "left").filter((F.col("scope") == F.col("top")) | F.coalesce(F.arrays_overlap("way", "ds"), F.lit(False))).filter("not target or verb = 'DELETE'").select("template_id", F.col("schema").alias("os"), F.col("name").alias("on")).distinct()
    outer = checkpointed(outer)
    nested = met(parts, met(parts, subs, inside, ["template_id", "sub"]), outer.select("template_id", F.col("os").alias("schema"), F.col("on").alias("name")), ["template_id", "schema", "name"], "left_anti")
    return met(parts, nested, outer, ["template_id"]).select("template_id", F.col("schema").alias("src_schema"), F.col("name").alias("src_table"), none.alias("src_col"), F.col("os").alias("dst_schema"), F.col("on").alias("dst_table"), none.alias("dst_col"), F.when(F.col("behind") == "EXISTS", "EXISTS").otherwise("SUBQUERY").alias("relation_type"), F.lit("INDIRECT").alias("lineage_type"))


def column_lineage(statements: DataFrame) -> DataFrame:
    """(template_id, src_schema, src_table, src_col, dst_schema, dst_table, dst_col) of INSERT .. SELECT and CREATE TABLE AS.

    The target's column is the one of the same place in its column list, or the item's own name where there is no list.
    What an item is made of is followed through derived tables and WITH names to the columns of tables.
    """
    toks = checkpointed(tokens(statements))
    parts = parts_of(toks)
    refs = checkpointed(references(toks))
    target = refs.filter("target and verb in ('INSERT', 'CREATE', 'WITH')").groupBy("template_id").agg(F.min_by(F.struct("schema", "name", "pos"), "pos").alias("t"))
    # the column list: names in the bracket behind the target, before the first SELECT
    begins = toks.filter("token = 'SELECT' and scope = -1").groupBy("template_id").agg(F.min("pos").alias("select_at"))
    listed = met(parts, met(parts, toks, target, ["template_id"]), begins, ["template_id"]).filter((F.col("pos") > F.col("t.pos") + 1) & (F.col("pos") < F.col("select_at")) & ~F.col("flat") & is_name(F.col("token")))
    columns = listed.withColumn("item", F.row_number().over(by_place()) - 1).select("template_id", "item", last_part(F.col("token")).alias("named"))
    items = met(parts, met(parts, select_items(toks).filter("scope = -1"), target, ["template_id"]), columns, ["template_id", "item"], "left")
    keyed = items.withColumn("key", F.concat_ws("|", "core", "item", F.coalesce("named", "out")))
    found = origins(keyed.select("template_id", "key", "scope", "core", "qualifier", "col"), toks, refs)
    return met(parts, found, target, ["template_id"]).select("template_id", F.col("schema").alias("src_schema"), F.col("table").alias("src_table"), F.col("col").alias("src_col"), F.col("t.schema").alias("dst_schema"), F.col("t.name").alias("dst_table"), F.substring_index("key", "|", -1).alias("dst_col")).distinct()
