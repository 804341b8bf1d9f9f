"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOUTY = r"(?<![A-Za-z0-9_])[A-Z][A-Z_0-9]{2,}(?![A-Za-z0-9_])"
CAMEL_PHRASE = r"[A-Z][a-z]+(?:[ -][A-Z][a-z]+)+"
TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"
MONTH_SUFFIX = r"_\d{6}$"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lineno from 1, line)."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("lineno", "line")).withColumn("lineno", F.col("lineno") + 1)


def shouty_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SHOUTY), F.lit(0))


def camel_phrases(text: Column) -> Column:
    """Runs of two or more capitalised words, glued."""
    return F.transform(F.regexp_extract_all(text, F.lit(CAMEL_PHRASE), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct tokens that the passage holds."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, passage)) / F.size(q)).otherwise(0.0)


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 but for case, 2 prefix, 3 inside; null for no match."""
    low = F.lower(name)
    q = query.lower()
    return F.when(name == query, 0).when(low == q, 1).when(F.startswith(low, F.lit(q)), 2).when(F.contains(low, F.lit(q)), 3)


def fqn(container: Column, name: Column) -> Column:
    return F.replace(F.concat_ws(".", F.nullif(container, F.lit("")), name), F.lit("#"), F.lit("."))


def canonical(*parts: Column) -> Column:
    """Parts joined by dots without the blank ones."""
    return F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts])


def preprocessed_sql(sql: Column) -> Column:
    """Placeholders that no parser takes become literals or names."""
    for pattern, by in ((r"\$\{[^}]*\}", "PH"), (r"#\{[^}]*\}", ":p"), (r"\{([A-Za-z_]\w*)\}", "$1"), (r"\(\+\)", ""), (r"@[A-Za-z_]\w*", ""), (r"%[sd]", "PH")):
        sql = F.regexp_replace(sql, pattern, by)
    return sql


def normalised_table(name: Column, shard: str = r"_\d{1,2}$", typos: dict[str, str] | None = None, month: str | None = MONTH_SUFFIX) -> Column:
    """Upper case, known typos mended, then without shard suffix, then without month suffix (month None: none is cut)."""
    out = F.upper(F.btrim(name))
    if typos:
        out = F.coalesce(F.create_map(*[F.lit(x) for pair in typos.items() for x in pair])[out], out)
    out = F.regexp_replace(out, shard, "")
    return F.regexp_replace(out, month, "") if month else out


def datasource_key(url: Column) -> Column:
    """host/service or host/database of a jdbc url."""
    return F.lower(F.regexp_extract(url, r"^jdbc:[a-z]+:(?:thin:)?@?(?://)?([^?;\s]+)", 1))


def normalised_key(key: Column) -> Column:
    """${key:default} -> key, without quotes."""
    bare = F.btrim(key, F.lit("\"' "))
    return F.when(bare.rlike(r"^\$\{[^}]*\}$"), F.regexp_extract(bare, r"^\$\{([^:}]*)", 1)).otherwise(bare)


def folded_text(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def language(text: Column) -> Column:
    """By the share of CJK among letters: zh above 0.6, en below 0.1 or without letters, else mixed."""
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    share = cjk / F.nullif(cjk + latin, F.lit(0))
    return F.when(share.isNull() | (share < 0.1), "en").when(share > 0.6, "zh").otherwise("mixed")


def is_garbage(text: Column, signals: list[str], short: int = 20, least_alpha: float = 0.5) -> Column:
    """Short, with few letters, and without a signal word."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    thin = letters / F.greatest(F.length(text), F.lit(1)) < least_alpha
    signalled = F.lit(False)
    for word in signals:
        signalled = signalled | F.contains(F.lower(text), F.lit(word.lower()))
    return (F.length(F.btrim(text)) < short) & thin & ~signalled


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2.5)


def excerpt(text: Column, most: int) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, most)


def bounded_summary(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last newline if there is one."""
    cut = F.substring(text, 1, most)
    at_line = F.regexp_extract(cut, r"(?s)^(.*)\n", 1)
    return F.when(F.length(text) <= most, text).when(at_line != "", at_line).otherwise(cut)


def value_type(value: Column) -> Column:
    low = F.lower(F.btrim(value))
    return F.when(low.isin("true", "false"), "bool").when(low.rlike(r"^[-+]?\d+$"), "int").otherwise("string")


def term_expansions(term: Column, most: int = 2) -> Column:
    """The term, then its prefixes without the last words, the longest first, of two words at least."""
    words = F.regexp_extract_all(term, F.lit(r"[A-Z]+(?![a-z])[0-9]*_*|[A-Z]?[a-z0-9]+_*|[A-Z]_*|[^A-Za-z0-9_]+|_+"), F.lit(0))
    counts = F.when(F.size(words) > 2, F.slice(F.sequence(F.size(words) - 1, F.lit(2), F.lit(-1)), 1, most)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(counts, lambda k: F.regexp_replace(F.array_join(F.slice(words, 1, k), ""), "_+$", ""))
    return F.array_distinct(F.concat(F.array(term), prefixes))


def glossary_hits(text: Column, terms: list[str]) -> Column:
    """The glossary's terms that the text holds, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def table_like_tokens(text: Column, prefixes: list[str]) -> Column:
    """Upper-case tokens with an underscore or a known prefix."""
    known = "|".join(prefixes) or "(?!)"
    return F.filter(F.array_distinct(shouty_tokens(text)), lambda t: F.contains(t, F.lit("_")) | t.rlike(f"^(?:{known})"))


def acronyms(text: Column, prefixes: list[str]) -> Column:
    """The other upper-case tokens."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]+(?![A-Za-z0-9_])"), F.lit(0))), table_like_tokens(text, prefixes))


def corpus_of(path: Column, corpora: dict[str, str]) -> Column:
    """The corpus whose folder is the longest prefix of a path; '' for none."""
    out = F.lit("")
    for name, folder in sorted(corpora.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(path, F.lit(folder)), name).otherwise(out)
    return out


def compatible(text: Column) -> Column:
    """NFKC form in folded case without white space; no built-in has that form, so whole Arrow batches go to Python."""

    @F.pandas_udf("string")
    def folded(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).casefold())

    return folded(text)


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case letters and digits with single hyphens between, at most `most`; 'run' where nothing is left."""
    bare = lambda x: F.btrim(x, F.lit("-"))
    return F.coalesce(F.nullif(bare(F.substring(bare(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")), 1, most)), F.lit("")), F.lit("run"))


def run_id(summary: Column, now: Column, short_hash: Column) -> Column:
    return F.concat_ws("-", F.date_format(now, "yyyyMMdd-HHmmss"), slug(summary), short_hash)


def has_signal(text: Column, exact: list[str], folded: list[str]) -> Column:
    """Whether a text holds one of the words, some of them without regard to case."""
    body = F.coalesce(text, F.lit(""))
    held = [F.contains(body, F.lit(w)) for w in exact] + [F.contains(F.lower(body), F.lit(w.lower())) for w in folded]
    return reduce(Column.__or__, held, F.lit(False))


def summary_of(body: Column, least: int = 10, most: int = 10) -> Column:
    """The first `most` paragraphs of at least `least` characters that are no metadata, apart by blank lines."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.btrim(x))
    told = F.filter(lines, lambda x: (F.length(x) >= least) & ~x.rlike(r"(?i)^(version|date|author|approved by)\s*[:|]"))
    return F.coalesce(F.nullif(F.array_join(F.slice(told, 1, most), "\n\n"), F.lit("")), F.lit("(empty docx)"))


def modules_of(tables: Column, name: Column, summary: Column, prefixes: dict[str, str], known: list[str], indexed: list[str]) -> Column:
    """Modules by table prefix, by words in a function's name, and by words of indexed modules in a summary; sorted."""
    begins = lambda p: F.exists(tables, lambda t: F.startswith(F.upper(t), F.lit(p)))
    by_table = [F.when(begins(p), m) for p, m in prefixes.items()]
    by_name = [F.when(F.contains(F.lower(name), F.lit(m)), m) for m in known]
    by_text = [F.when(F.contains(F.lower(summary), F.lit(m)), m) for m in indexed]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*by_table, *by_name, *by_text))))


def is_stale(refreshed: Column, now: Column, ttl_hours: int) -> Column:
    """Whether a refresh is longer ago than the time to live; one that is missing or cannot be read counts as stale."""
    zoned = r"(Z|[+-]\d{2}:?\d{2})$"
    age = F.unix_timestamp(F.try_to_timestamp(now)) - F.unix_timestamp(F.try_to_timestamp(refreshed))
    return F.coalesce((refreshed.rlike(zoned) != now.rlike(zoned)) | (age > ttl_hours * 3600), F.lit(True))


# The forms of names that lookups take.
FQN_FORM = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$<][A-Za-z0-9_$>]*)*(\([^;|&]{0,512}\))?$"
IDENTIFIER_FORM = r"^[A-Za-z_][A-Za-z0-9_$#]*$"
EXTENSION_FORM = r"^[A-Za-z0-9]{1,10}$"
TABLE_FORM = r"^[A-Z][A-Z0-9_]*\.[A-Z][A-Z0-9_]*$"
CONFIG_FORM = r"^[A-Za-z0-9_\-]+(\.[A-Za-z0-9_\-]+)*$"


def is_pointer(pointer: Column) -> Column:
    """Whether an evidence pointer has one of the allowed forms: fqn:<dotted name>, table:OWNER.TABLE, config:<key path>."""
    kind, body = F.substring_index(pointer, ":", 1), F.regexp_extract(pointer, r"(?s)^[a-z]+:(.*)$", 1)
    shape = F.when(kind == "fqn", body.rlike(FQN_FORM) & (F.length(body) <= 512)).when(kind == "table", body.rlike(TABLE_FORM)).when(kind == "config", body.rlike(CONFIG_FORM))
    return F.coalesce(shape & ~F.contains(pointer, F.lit("\n")), F.lit(False))


def stop_word(line: Column) -> Column:
    """The word that a line of a stop list gives, in upper case: its first token; null for blank lines and comments."""
    return F.nullif(F.upper(F.regexp_extract(line, r"^\s*([^\s#]+)", 1)), F.lit(""))


def requirement_text(text: Column) -> Column:
    """Three and more blank lines become one, ends are bare."""
    return F.btrim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n(?:[ \t]*\n){3,}", "\n\n"), F.lit(" \n\t"))
