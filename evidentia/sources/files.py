"""Files as rows: scans by path and content, and parsers for the formats that evidence comes in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import value_type
from evidentia.session import checkpointed, parts_for


# Words that no statement to be sent may hold; TRUNCATE is one only before what it truncates.
WRITING = r"(?i)\b(?:delete|update|insert|drop|merge|create|alter|grant|revoke|exec|execute|call|begin)\b|\btruncate\s+(?:table|cluster)\b"


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all files under a root, as whole texts; any storage that Spark reads."""
    rows = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob."""
    return "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def scanned(files: DataFrame, extensions: list[str], exclude_dirs: list[str], include: list[str] | None = None) -> DataFrame:
    """Files by extension and place: adds language, module (first part of the path) and category."""
    path = F.col("path")
    kept = F.lower(path).rlike(r"\.(?:" + "|".join(extensions) + ")$") & ~path.rlike(r"(?:^|/)~\$")
    if exclude_dirs:
        kept = kept & ~path.rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, exclude_dirs)) + ")/")
    if include:
        kept = kept & path.rlike("|".join(map(glob_pattern, include)))
    dao = F.lower(path).rlike("dao|mapper|repository") & F.lower(path).rlike(r"\.sql$")
    return files.filter(kept).dropDuplicates(["path"]).withColumns({"language": F.regexp_extract(F.lower(path), r"\.(\w+)$", 1), "module": F.substring_index(path, "/", 1), "category": F.when(dao, "dao_sql").otherwise("other_sql")})


def mapper_files(files: DataFrame) -> DataFrame:
    """XML files that are mappers by content, outside backup trees."""
    return files.filter(F.col("content").rlike(r"<mapper\s+namespace\s*=") & ~F.col("path").rlike(r"(?:^|/)[^/]*-bak/"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are that, else GBK, else UTF-8 with replacement marks. A lookup of each text's bytes
    in Arrow batches, as no built-in tells bad bytes from good ones for both encodings."""

    @F.pandas_udf("string")
    def read(rows: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            for encoding in ("utf-8", "gbk"):
                try:
                    return data.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return data.decode("utf-8", "replace")

        return rows.map(lambda x: None if x is None else one(bytes(x)))

    return read(content)


def properties_items(files: DataFrame) -> DataFrame:
    """(path, key_path, value, value_type) of .properties files: comments, continued lines, first of = and :."""
    joined = F.regexp_replace("content", r"\\\r?\n[ \t]*", "")
    lines = files.select("path", F.posexplode(F.split(joined, r"\r?\n")).alias("n", "line"))
    kept = lines.filter(~F.col("line").rlike(r"^\s*([#!]|$)") & F.col("line").rlike("[=:]"))
    value = F.btrim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1))
    return kept.select("path", F.btrim(F.regexp_extract("line", r"^([^=:]*)[=:]", 1)).alias("key_path"), value.alias("value"), value_type(value).alias("value_type"))


def flattened(tree: Any, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted path, scalar) of a tree of maps and lists."""
    if isinstance(tree, dict):
        for key, below in tree.items():
            yield from flattened(below, f"{path}.{key}" if path else str(key))
    elif isinstance(tree, list):
        for i, below in enumerate(tree):
            yield from flattened(below, f"{path}[{i}]")
    elif path:
        yield path, "" if tree is None else str(tree).lower() if isinstance(tree, bool) else str(tree)


def tree_items(files: DataFrame) -> DataFrame:
    """(path, key_path, value, value_type) of YAML and JSON files; a file that cannot be read has none."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same parser in C, where it is built
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    tree = json.loads(content) if path.endswith(".json") else yaml.load(content, loader)
                except (ValueError, yaml.YAMLError):
                    continue
                out += [(path, key, value) for key, value in flattened(tree)]
            yield pd.DataFrame(out, columns=["path", "key_path", "value"])

    dealt = files.select("path", "content").repartition(parts_for(files, "content"), "path")  # a few files may hold all rows
    items = dealt.mapInPandas(task, "path string, key_path string, value string")
    return items.withColumn("value_type", value_type(F.col("value")))


def spring_beans(files: DataFrame) -> DataFrame:
    """(path, bean, class, property, value) of Spring XML, by patterns over the text of each bean."""
    beans = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<bean\b.*?(?:</bean>|/>(?!\s*<property))"), F.lit(0))).alias("bean_xml"))
    attribute = lambda source, name: F.regexp_extract(source, name + r'\s*=\s*"([^"]*)"', 1)
    named = beans.select("path", attribute("bean_xml", r"\bid").alias("bean"), attribute("bean_xml", r"\bclass").alias("class"), F.regexp_extract_all("bean_xml", F.lit(r"<property\b[^>]*>"), F.lit(0)).alias("props"))
    return named.select("path", "bean", "class", F.explode_outer("props").alias("p")).select("path", "bean", "class", attribute("p", "name").alias("property"), attribute("p", "value").alias("value"))


INCLUDE = r"""(?s)<include\b[^>]*?\brefid\s*=\s*["']([^"']*)["'][^>]*?(?:/>|>.*?</include>)"""
#: Tags at which a dynamic statement takes one of several ways.
BRANCH = r"""(?s)</?(?:if|when|otherwise|choose)\b(?:"[^"]*"|'[^']*'|[^'">])*>"""


def xml_attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""^<[^>]*?\b{name}\s*=\s*["']([^"']*)["']""", 1)


def include_parts(body: Column) -> Column:
    """A body as an array of (text, ref): what stands between includes, each behind it its include ('' for none)."""
    mark = "\x01"
    pieces = F.split(F.regexp_replace(body, INCLUDE, mark + "$1" + mark), mark)
    return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(2)), lambda i: F.struct(F.element_at(pieces, i + 1).alias("text"), F.when(i + 2 <= F.size(pieces), F.element_at(pieces, i + 2)).otherwise("").alias("ref")))


def mapper_fragments(files: DataFrame) -> DataFrame:
    """(path, ns, id, parts): the <sql> fragments of mapper files, the first of an id in its file."""
    content = F.regexp_replace("content", r"(?s)<!--.*?-->", " ")
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<sql\b[^>]*>.*?</sql>"), F.lit(0))
    found = files.select("path", F.regexp_extract(content, r"""<mapper\b[^>]*?\bnamespace\s*=\s*["']([^"']*)["']""", 1).alias("ns"), F.posexplode(blocks).alias("at", "x"))
    body = F.regexp_extract("x", r"(?s)^<sql\b[^>]*>(.*)</sql>$", 1)
    return found.groupBy("path", xml_attribute(F.col("x"), "id").alias("id")).agg(F.min_by(F.struct("ns", include_parts(body).alias("parts")), "at").alias("f")).filter("id <> ''").select("path", "f.ns", "id", "f.parts")


def mapper_statements(files: DataFrame) -> DataFrame:
    """(path, statement, verb, sql, branches): namespace.id of each statement with its text without tags.

    An include takes the <sql> fragment of its refid: of the statement's own file, else the fragment of that full name
    (namespace.id), else the first file's (by path) of that bare id; also inside fragments, to any depth and over files.
    A fragment inside itself and an unknown one are blank. branches are the stretches between the tags at which a
    statement takes one of several ways. Includes are filled round by round, each a join of the open ones with the
    fragments, as many rounds as fragments are nested.
    """
    content = F.regexp_replace("content", r"(?s)<!--.*?-->", " ")
    namespace = F.regexp_extract(content, r"""<mapper\b[^>]*?\bnamespace\s*=\s*["']([^"']*)["']""", 1)
    statements = F.regexp_extract_all(content, F.lit(r"(?s)<(?:select|insert|update|delete)\b[^>]*>.*?</(?:select|insert|update|delete)>"), F.lit(0))
    found = files.select("path", namespace.alias("ns"), F.posexplode(statements).alias("n", "x"))
    named = found.select("path", "n", F.concat_ws(".", "ns", xml_attribute(F.col("x"), "id")).alias("statement"), F.regexp_extract("x", r"^<(\w+)", 1).alias("verb"), include_parts(F.col("x")).alias("parts"))
    fragments = checkpointed(mapper_fragments(files).withColumn("key", F.concat_ws("#", "path", "id")))
    # joined by sorting: Spark sizes what is exploded by the files that it came from, and would broadcast all fragments
    local = fragments.select("path", F.col("id").alias("ref"), F.struct("key", "parts").alias("local")).hint("merge")
    full = fragments.filter("ns <> ''").select(F.concat_ws(".", "ns", "id").alias("ref"), F.lit(0).alias("way"), "path", "key", "parts")
    bare = fragments.select(F.col("id").alias("ref"), F.lit(1).alias("way"), "path", "key", "parts")
    everywhere = full.unionByName(bare).groupBy("ref").agg(F.min_by(F.struct("key", "parts"), F.struct("way", "path")).alias("anywhere")).hint("merge")

    keys = ("path", "n", "statement", "verb")
    rows = named.select(*keys, F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("chain"), "parts")
    done, opened = [], rows
    while True:
        apart = opened.select(*keys, "place", "chain", F.posexplode("parts").alias("i", "part"))
        step = checkpointed(apart.select(*keys, F.concat("place", F.array(F.col("i"))).alias("place"), "chain", "part.text", "part.ref"))
        done.append(step.select(*keys, "place", "text"))
        asked = step.filter("ref <> ''")
        if asked.isEmpty():
            break
        met = asked.join(local, ["path", "ref"], "left").join(everywhere, "ref", "left").withColumn("f", F.coalesce("local", "anywhere"))
        # what an include gives stands behind the text before it, hence one place further
        opened = met.filter(F.col("f").isNotNull() & ~F.array_contains("chain", F.col("f.key"))).select(*keys, F.concat("place", F.array(F.lit(0))).alias("place"), F.concat("chain", F.array("f.key")).alias("chain"), F.col("f.parts").alias("parts"))
    whole = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("body"))
    bare_text = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"""(?s)<!\[CDATA\[(.*?)\]\]>|</?[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>""", " $1 "), r"\s+", " "))
    branches = F.filter(F.transform(F.split("body", BRANCH), bare_text), lambda x: x != "")
    return whole.select("path", "statement", "verb", bare_text(F.col("body")).alias("sql"), branches.alias("branches"))


def xml_kind(content: Column) -> Column:
    """What an XML file is by its root tag: mapper, beans or other."""
    root = F.regexp_extract(F.regexp_replace(content, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"^\s*<([\w:.-]+)", 1)
    return F.when(root == "mapper", "mapper").when(root == "beans", "beans").otherwise("other")


def bean_items(files: DataFrame) -> DataFrame:
    """(path, key_path, value, value_type) of Spring XML: bean.property with its value."""
    rows = spring_beans(files.filter(xml_kind(F.col("content")) == "beans")).filter("coalesce(property, '') <> ''")
    return rows.select("path", F.concat_ws(".", "bean", "property").alias("key_path"), "value", value_type(F.col("value")).alias("value_type"))


#: Extension -> what takes configuration items out of such files; add an entry to read another format.
ITEM_PARSERS = {"properties": properties_items, "yml": tree_items, "yaml": tree_items, "json": tree_items, "xml": bean_items}
#: JSON files that hold no configuration.
NOT_CONFIGURATION = ("package.json", "package-lock.json", "tsconfig.json")


def config_items(files: DataFrame) -> DataFrame:
    """(path, key_path, value, value_type) of all configuration files, each by its extension's parser."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.filter(~name.isin(*NOT_CONFIGURATION)).withColumn("__ext", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    by_parser: dict = {}
    for extension, parser in ITEM_PARSERS.items():
        by_parser.setdefault(parser, []).append(extension)
    parts = [parser(kept.filter(F.col("__ext").isin(*extensions)).drop("__ext")) for parser, extensions in by_parser.items()]
    return reduce(DataFrame.unionByName, parts)


def ddl_columns(files: DataFrame) -> DataFrame:
    """(path, table, ordinal, column, type) of every CREATE TABLE in the texts."""
    tables = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)create\s+table\s+[\w.\"]+\s*\(.*?\)\s*;"), F.lit(0))).alias("ddl"))
    body = F.regexp_extract("ddl", r"(?is)^create\s+table\s+[\w.\"]+\s*\((.*)\)\s*;$", 1)
    name = F.upper(F.element_at(F.split(F.regexp_extract("ddl", r"(?is)^create\s+table\s+([\w.\"]+)", 1), r"\."), -1))
    columns = tables.select("path", name.alias("table"), F.posexplode(F.split(body, r",(?![^(]*\))")).alias("ordinal", "c"))
    kept = columns.withColumn("c", F.btrim(F.regexp_replace("c", r"\s+", " "))).filter(~F.upper("c").rlike(r"^(PRIMARY|FOREIGN|CONSTRAINT|UNIQUE|CHECK)\b"))
    return kept.select("path", "table", "ordinal", F.upper(F.substring_index("c", " ", 1)).alias("column"), F.upper(F.regexp_extract("c", r"^\S+ (\w+(?:\([^)]*\))?)", 1)).alias("type"))


def tns_aliases(files: DataFrame) -> DataFrame:
    """(alias, host, port, service) of connect descriptors, host and service in lower case."""
    entry = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*[\w.]+\s*=\s*\(DESCRIPTION[\s\S]*?\)\s*\)\s*\)"), F.lit(0))).alias("e")
    value = lambda name: F.regexp_extract("e", rf"(?i)\({name}\s*=\s*([^)\s]+)", 1)
    rows = files.select(entry)
    return rows.select(F.upper(F.regexp_extract("e", r"^\s*([\w.]+)", 1)).alias("alias"), F.lower(value("HOST")).alias("host"), value("PORT").cast("int").alias("port"), F.lower(F.coalesce(F.nullif(value("SERVICE_NAME"), F.lit("")), value("SID"))).alias("service"))


def easy_connect(name: Column) -> Column:
    """host[:port]/service as a struct; null for another form."""
    shape = r"^(?://)?([\w.\-]+)(?::(\d+))?/([\w.\-]+)$"
    part = lambda k: F.regexp_extract(name, shape, k)
    return F.when(name.rlike(shape), F.struct(F.lower(part(1)).alias("host"), F.coalesce(part(2).try_cast("int"), F.lit(1521)).alias("port"), F.lower(part(3)).alias("service")))


def jsonl_methods(rows: DataFrame) -> DataFrame:
    """Indexer rows (camel or snake case) as methods: lines from 0, # as ., none without a name, the first of equals."""
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns])
    line = lambda *names: F.greatest(has(*names).cast("int") - 1, F.lit(0))
    out = rows.select(F.replace(has("methodFqn", "method_fqn"), F.lit("#"), F.lit(".")).alias("method_fqn"), has("sourceFile", "source_file").alias("source_file"), line("startLine", "start_line").alias("start_line"), line("endLine", "end_line").alias("end_line"))
    return out.filter("coalesce(method_fqn, '') <> ''").dropDuplicates(["method_fqn", "source_file"])


def readonly(sql: Column) -> Column:
    """Whether a statement may be sent: one statement, SELECT or WITH, no keyword that changes anything; null may not."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    one = ~F.regexp_replace(F.btrim(bare), r";+\s*$", "").contains(";")
    return F.coalesce(one & bare.rlike(r"(?i)^\s*(select|with)\b") & ~bare.rlike(WRITING), F.lit(False))


def refused_instance(name: Column, allowed: list[str]) -> Column:
    """Why an instance may not be queried: a word of production in its name, or not on the list (in any case); null if it
    may. A null name is not on any list."""
    return F.when(F.upper(name).rlike("PROD|PRD|LIVE|MASTER|RELEASE"), "production").when(name.isNull() | ~F.upper(name).isin(*[a.upper() for a in allowed]), "not allowed")


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """At most cap rows, each with `truncated`: whether there are more. One row beyond the cap is read, no more."""
    probe = rows.limit(cap + 1)
    return probe.limit(cap).crossJoin(F.broadcast(probe.agg((F.count("*") > cap).alias("truncated"))))


def bounded_query(spark: SparkSession, url: str, sql: str, allowed: list[str], cap: int = 1000, **options: str) -> DataFrame:
    """A read-only query over JDBC on an allowed instance (its url): at most cap rows, with `truncated`."""
    why = spark.range(1).select(F.when(~readonly(F.lit(sql)), "only one SELECT or WITH statement is allowed").otherwise(refused_instance(F.lit(url), allowed))).first()[0]
    if why:
        raise ValueError(f"refused: {why}")
    return capped(spark.read.format("jdbc").options(url=url, query=sql, **options).load(), cap)


def case_markdown(cases: DataFrame) -> DataFrame:
    """(case_id, markdown): a machine-readable head in a comment, then the case to read."""
    head = F.concat(F.lit("<!--ops-case\n"), F.to_json(F.struct(*[c for c in cases.columns])), F.lit("\n-->"))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.substring("case_id", 1, 12)), F.lit("## Signature"), "signature", F.lit("## Root cause"), "root_cause")
    return cases.select("case_id", F.concat_ws("\n", head, body).alias("markdown"))


def cases_from_markdown(files: DataFrame, schema: str) -> DataFrame:
    """The heads of case files as columns; a file without one is left out."""
    head = F.regexp_extract("content", r"(?s)<!--ops-case\s*(\{.*?\})\s*-->", 1)
    return files.filter(head != "").select(F.from_json(head, schema).alias("c")).select("c.*")


def sheet_rows(cells: DataFrame, aliases: dict[str, list[str]], look: int = 10) -> DataFrame:
    """Rows of sheets given as cells(sheet, row, col, value): the header is the first of `look` rows with two known names,
    and the row below it where that names further columns.

    Returns (sheet, row, field, value) for the fields that aliases names; titles above and subtotal rows are left out.
    """
    known = [(alias.lower(), field) for field, names in aliases.items() for alias in names]
    field = F.lit(None).cast("string")
    for alias, name in known:
        field = F.when(F.lower(F.btrim("value")) == alias, name).otherwise(field)
    named = cells.filter(F.col("row") < look).withColumn("field", field).filter("field is not null")
    header = named.groupBy("sheet", "row").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("sheet").agg(F.min("row").alias("header"))
    first = named.join(header, "sheet").filter("row = header").select("sheet", "header", "col", "field")
    second = named.join(header, "sheet").filter("row = header + 1").join(first.select("sheet", "col"), ["sheet", "col"], "left_anti").select("sheet", "header", "col", "field")
    both = first.unionByName(second)
    # data begin below the last row of the header
    ends = second.groupBy("sheet").agg(F.lit(1).alias("more"))
    columns = both.join(ends, "sheet", "left").select("sheet", (F.col("header") + F.coalesce("more", F.lit(0))).alias("header"), "col", "field")
    totals = cells.filter(F.lower("value").rlike("^(sub)?total")).select("sheet", "row").distinct()
    data = cells.join(columns, ["sheet", "col"]).filter("row > header").join(totals, ["sheet", "row"], "left_anti")
    return data.select("sheet", "row", "field", "value")
