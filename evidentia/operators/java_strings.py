"""SQL put together in Java source: a file as a table of tokens, its blocks by level, definitions joined to their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import met, parts_for, stored

# What makes a text a statement, where statements are sent to, and what may or may not run.
SQL_HINTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "FROM", "JOIN")
SQL_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "WITH")
SINKS = ("prepareStatement", "createQuery", "executeQuery", "executeUpdate", "execute", "prepareCall", "nativeQuery", "createNativeQuery", "createSQLQuery", "addBatch", "setSql", "sqlQuery")
BRANCHES = ("if", "else", "for", "while", "switch")
BUILDERS = ("StringBuilder", "StringBuffer")
UNKNOWN = "${?}"

TOKEN = r"""(?s)/\*.*?\*/|//[^\n]*+|\"{3}.*?\"{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\n|[A-Za-z_$][\w$]*+|\d[\w.]*+|[-+*/%=!<>&|^]?=|\+\+|--|&&|\|\||->|::|\S"""
MODIFIERS = ("public", "private", "protected", "static", "final", "new", "return", "else", "throw", "case", "do")


def _is_text(tok: Column) -> Column:
    return F.startswith(tok, F.lit('"'))


def _bare(tok: Column) -> Column:
    quotes = F.when(F.startswith(tok, F.lit('"' * 3)), 3).otherwise(1)
    return F.substring(tok, quotes + 1, F.length(tok) - 2 * quotes)


def tokens(files: DataFrame) -> DataFrame:
    """(path, pos, tok, line, prev, prev2, depth, stmt, rel) of the code of files(path, content), without comments.

    depth counts the open braces, stmt the statements (up to ";", "{" or "}"), rel the open brackets of calls in the
    statement; brackets that only group count nothing. Everything is a running sum over a file; a bracket's kind is
    that of the last one opened at its level.
    """
    raw = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    by = Window.partitionBy("path").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    tok = F.col("tok")

    def running(x: Column, over: Window = by.rowsBetween(Window.unboundedPreceding, 0)) -> Column:
        return F.coalesce(F.sum(x).over(over), F.lit(0))

    lined = raw.withColumn("line", 1 + running(F.length(tok) - F.length(F.replace(tok, F.lit("\n"), F.lit(""))), before))
    code = lined.filter((tok != "\n") & ~F.startswith(tok, F.lit("//")) & ~F.startswith(tok, F.lit("/*")))
    step = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)
    placed = code.withColumns({"prev": F.lag("tok").over(by), "prev2": F.lag("tok", 2).over(by), "paren": running(step), "depth": running(F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0), before)})
    level = F.col("paren") + (tok == ")").cast("int")
    call = F.coalesce(F.col("prev").rlike(r"^[A-Za-z_$]") & ~F.col("prev").isin("return", "case"), F.lit(False))
    opener = F.last(F.when(tok == "(", call), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("pos"))
    kinds = placed.withColumn("level", level).withColumn("call", tok.isin("(", ")") & F.coalesce(opener, F.lit(False)))
    calls = kinds.withColumn("calls", running(F.when(F.col("call"), step).otherwise(0)))
    brace = tok.isin("{", "}")
    base = F.last(F.when(brace, F.struct("paren", "calls")), ignorenulls=True).over(before)
    based = calls.withColumn("base", base)
    ends = brace | ((tok == ";") & (F.col("paren") <= F.coalesce("base.paren", F.lit(0))))
    rel = F.col("calls") + ((tok == ")") & F.col("call")).cast("int") - F.coalesce("base.calls", F.lit(0))
    return based.select("path", "pos", "tok", "line", "prev", "prev2", "depth", running(ends.cast("int"), before).alias("stmt"), rel.alias("rel"))


def surroundings(toks: DataFrame, parts: int) -> DataFrame:
    """(path, stmt, method(level, stmt, name), class(level, name), branch) of each statement inside a class.

    A statement at depth d is inside the last block opened at each level below d, so blocks and statements meet by
    (file, level) in one ordered pass and not as pairs.
    """
    shown = F.when(_is_text(F.col("tok")), '""').otherwise(F.col("tok"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"]), " ")
    stmts = toks.groupBy("path", "stmt").agg(F.min_by("depth", "pos").alias("depth"), text.alias("text"))
    type_name = F.regexp_extract("text", r"(?:^|[^.] )(?:class|interface|enum|record) ([\w$]+)", 1)
    shape = r"(?:^|.* )([\w$]+|>|\]) ([\w$]+) \( (?:.* )?\) (?:throws .*)?\{$"
    method_name = F.regexp_extract("text", shape, 2)
    is_branch = F.col("text").rlike(rf"^(?:{'|'.join(BRANCHES)})\b")
    plain = ~is_branch & ~F.col("text").rlike(r"^(?:try|catch|synchronized|do)\b| = | -> |(?:^| )new ")
    is_method = plain & (method_name != "") & ~F.regexp_extract("text", shape, 1).isin(*MODIFIERS)
    kind = F.when(is_branch, "branch").when(type_name != "", "class").when(is_method, "method").otherwise("other")
    opened = F.struct(kind.alias("kind"), F.when(kind == "class", type_name).otherwise(method_name).alias("name"), "stmt")
    heads = stmts.filter(F.endswith("text", F.lit("{"))).select("path", "stmt", F.col("depth").alias("level"), opened.alias("head"), F.lit(False).alias("asks"), F.lit(False).alias("own"))
    asks = stmts.filter("depth > 0").select("path", "stmt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("level"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), F.lit(True).alias("asks"), is_branch.alias("own"))
    last = F.last("head", ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("stmt"))
    inside = heads.unionByName(asks).repartition(parts, "path").withColumn("head", last).filter("asks")

    def inner(kind: str, *names: str) -> Column:
        return F.max(F.when(F.col("head.kind") == kind, F.struct("level", *[f"head.{n}" for n in names])))

    found = inside.groupBy("path", "stmt").agg(inner("method", "stmt", "name").alias("method"), inner("class", "name").alias("class"), inner("branch").alias("within"), F.max("own").alias("own"))
    branch = F.col("own") | F.coalesce(F.col("within.level") > F.coalesce("method.level", F.lit(-1)), F.lit(False))
    return found.select("path", "stmt", "method", "class", branch.alias("branch"))


def _called(toks: Column) -> Column:
    """The text that format or replace gives where all that goes in is literal, else null."""
    args = F.filter(F.slice(toks, 5, F.greatest(F.size(toks) - 5, F.lit(0))), lambda x: x != ",")
    known = (F.get(toks, F.lit(1)) == ".") & (F.get(toks, F.lit(3)) == "(") & F.forall(args, lambda x: x.rlike(r'^(?:"|\d)'))
    values = F.transform(args, lambda x: F.when(_is_text(x), _bare(x)).otherwise(x))
    shape, rest = F.get(values, F.lit(0)), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    slots = F.regexp_extract_all(shape, F.lit("%[sSdD]"), F.lit(0))
    filled = F.array_join(F.transform(F.split(shape, "%[sSdD]"), lambda p, i: F.concat(p, F.coalesce(F.when(i < F.size(slots), F.get(rest, i)), F.get(slots, i), F.lit("")))), "")
    first, what = F.get(toks, F.lit(0)), F.get(toks, F.lit(2))
    replaced = F.when(_is_text(first) & (F.size(args) == 2) & F.forall(args, _is_text), F.replace(_bare(first), F.get(values, F.lit(0)), F.get(values, F.lit(1))))
    return F.when(known & (what == "format") & _is_text(F.get(args, F.lit(0))), filled).when(known & (what == "replace"), replaced)


def sql_strings(files: DataFrame) -> DataFrame:
    """(path, line_start, line_end, container, sql_text, recovery_mode, confidence, branch_detected): SQL in Java files.

    Values of declarations and assignments: a literal, or format and replace over literals alone (literal); parts put
    together, where names declared with a literal in the method are filled in (local_var) and all else is "${?}"
    (concat); and what is appended to a builder in a method, in the order of the source, with a flag where that depends
    on a branch. Confidence is medium for a declaration of the first two kinds or one that reaches a sink in its
    method, else low. Of a ternary, an assignment inside another, and an initialiser with a block nothing is taken.
    Files with null or no content give no rows.
    """
    hinted = files.filter(F.upper("content").rlike("|".join(SQL_HINTS))).select("path", "content")
    # what tokens become is read many times, so it is stored; partitions follow the texts' bytes, see parts_for
    parts = parts_for(hinted, "content")
    toks = stored(tokens(hinted.repartition(parts, "path"))).repartition(parts, "path")
    inside = stored(met(parts, toks, surroundings(toks, parts), ["path", "stmt"])).repartition(parts, "path", "stmt")
    tok, rel = F.col("tok"), F.col("rel")
    order = Window.partitionBy("path", "stmt").orderBy("pos")
    sets = F.when((rel == 0) & tok.isin("=", "+="), F.col("pos"))
    first = F.min(sets).over(order)
    split = inside.withColumn("part", F.coalesce(F.sum(F.when((rel == 0) & (tok == ",") & (F.col("pos") > first), 1)).over(order), F.lit(0)))
    at = Window.partitionBy("path", "stmt", "part")
    in_part = split.withColumns({"op": F.min(sets).over(at), "last": F.max_by("tok", "pos").over(Window.partitionBy("path", "stmt"))}).filter((F.col("last") == ";") & F.col("op").isNotNull())
    key = ["path", "method", "class", "stmt", "part"]
    is_op = F.col("pos") == F.col("op")
    declares = F.when(is_op, F.col("prev2").rlike(r"^(?:[\w$]+|>|\])$") & ~F.col("prev2").isin(*MODIFIERS))
    targets = in_part.groupBy(*key).agg(F.max(F.when(is_op, F.col("prev"))).alias("name"), F.max(declares).alias("typed"), F.max(F.when(is_op, F.col("line"))).alias("line_start"), F.max("line").alias("line_end"))
    declared = F.max("typed").over(Window.partitionBy("path", "stmt"))
    targets = targets.withColumn("declares", F.when(F.col("part") == 0, F.coalesce("typed", F.lit(False))).otherwise(declared))

    after = in_part.filter((F.col("pos") > F.col("op")) & (tok != ";"))
    counted = after.withColumn("operand", F.coalesce(F.sum(F.when((rel == 0) & (tok == "+"), 1)).over(at.orderBy("pos")), F.lit(0)))
    kept = counted.filter(~((rel == 0) & tok.isin("+", "(", ")", ",")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    operands = kept.groupBy(*key, "operand").agg(listed.alias("toks"), F.max((rel == 0) & tok.isin("?", "=")).alias("odd"))
    one = F.when(F.size("toks") == 1, F.get("toks", F.lit(0)))
    operands = operands.withColumns({"text": F.when(_is_text(one), _bare(one)), "uses": F.when(one.rlike(r"^[A-Za-z_$]"), one), "called": _called(F.col("toks"))})
    alone = operands.groupBy(*key).agg(F.count("*").alias("n"), F.max("text").alias("text"))
    literals = met(parts, targets.filter("declares"), alone.filter("n = 1 and text is not null").select("path", "stmt", "part", "text"), ["path", "stmt", "part"])
    known = literals.filter("method is not null").groupBy("path", F.col("method.stmt").alias("of"), "name").agg(F.max_by("text", F.struct("stmt", "part")).alias("value"))
    owned = met(parts, operands, targets.select("path", "stmt", "part", "name", "declares", "line_start", "line_end"), ["path", "stmt", "part"])
    k = known.select(F.col("path").alias("k_path"), "of", F.col("name").alias("k_name"), "value")
    own = F.col("declares") & (F.col("uses") == F.col("name"))
    filled = owned.repartition(parts, "path", "method.stmt", "uses").join(k.repartition(parts, "k_path", "of", "k_name").hint("merge"), (F.col("path") == F.col("k_path")) & (F.col("method.stmt") == F.col("of")) & (F.col("uses") == F.col("k_name")) & ~own, "left")
    value = F.coalesce("text", "value", F.lit(UNKNOWN))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("operand", value.alias("v")))), lambda x: x["v"]), "")
    values = filled.repartition(parts, "path", "stmt").groupBy(*key, "name", "declares", "line_start", "line_end").agg(together.alias("joined"), F.count("*").alias("n"), F.max("text").alias("only"), F.max("called").alias("called"), F.max("odd").alias("odd"), F.max(F.col("value").isNotNull()).alias("local")).filter("not odd")
    static = F.when(F.col("n") == 1, F.coalesce("only", "called"))
    mode = F.when(static.isNotNull(), "literal").when(F.col("local"), "local_var").otherwise("concat")

    sends = inside.filter("method is not null").withColumn("sink", F.max(tok.isin(*SINKS) & (F.lead("tok").over(order) == "(")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sunk = sends.filter((rel > 0) & F.col("sink")).select(F.col("path").alias("s_path"), F.col("method.stmt").alias("s_of"), F.col("tok").alias("s_name")).repartition(parts, "s_path").distinct()
    reach = values.withColumn("mode", mode).withColumn("sql_text", F.coalesce(static, "joined")).repartition(parts, "path", "method.stmt", "name").join(sunk.repartition(parts, "s_path", "s_of", "s_name").hint("merge"), (F.col("path") == F.col("s_path")) & (F.col("method.stmt") == F.col("s_of")) & (F.col("name") == F.col("s_name")), "left")
    sure = F.col("declares") & (F.col("mode").isin("literal", "local_var") | F.col("s_name").isNotNull())
    container = F.concat_ws(".", "class.name", "method.name")
    assigned = reach.select("path", "line_start", "line_end", container.alias("container"), "sql_text", F.col("mode").alias("recovery_mode"), F.when(sure, "medium").otherwise("low").alias("confidence"), F.lit(False).alias("branch_detected"))

    # builders: names declared as one, and the calls of append in statements that begin a chain at such a name
    in_method = inside.filter("method is not null").withColumn("of", F.col("method.stmt"))
    builders = in_method.filter(F.col("prev").isin(*BUILDERS) & (F.col("prev2") != "new") & tok.rlike(r"^[A-Za-z_$]")).select("path", "of", F.col("tok").alias("name")).repartition(parts, "path").distinct()
    nth = F.coalesce(F.sum(F.when((rel == 0) & (tok == "append") & (F.col("prev") == "."), 1)).over(order), F.lit(0))
    chained = in_method.withColumn("nth", nth).withColumn("dot", F.when((tok == ".") & (rel == 0) & (F.lead("tok").over(order) == "append"), F.struct("pos", "prev")))
    named = chained.withColumn("name", F.min("dot").over(Window.partitionBy("path", "stmt"))["prev"]).filter("nth > 0 and rel > 0")
    arguments = named.groupBy("path", "of", "class", "method", "name", "stmt", "nth").agg(listed.alias("toks"), F.max("branch").alias("branch"))
    inner = F.get("toks", F.lit(1))
    piece = F.when((F.size("toks") == 3) & _is_text(inner), _bare(inner)).when(F.size("toks") > 2, UNKNOWN).otherwise("")
    pieces = met(parts, arguments, builders, ["path", "of", "name"]).groupBy("path", "of", "class", "method", "name")
    built = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt", "nth", piece.alias("v")))), lambda x: x["v"]), "").alias("sql_text"), F.max("branch").alias("branch_detected"))
    spans = toks.groupBy("path", "stmt").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    heads = spans.select("path", F.col("stmt").alias("of"), F.col("lo").alias("line_start"))
    ends = in_method.select("path", "of", "line").repartition(parts, "path").groupBy("path", "of").agg(F.max("line").alias("line_end"))
    long = met(parts, met(parts, built, heads, ["path", "of"]), ends, ["path", "of"]).select("path", "line_start", "line_end", container.alias("container"), "sql_text", F.lit("string_builder").alias("recovery_mode"), F.lit("low").alias("confidence"), "branch_detected")
    upper, verbs = F.upper(F.btrim("sql_text")), "|".join(SQL_VERBS)
    return assigned.unionByName(long).filter(upper.rlike(rf"(?s)^(?:{verbs})| (?:{verbs}) "))
