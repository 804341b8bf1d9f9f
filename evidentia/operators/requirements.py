"""Requirement texts: numbered segments, groups within a token budget, grounding of extracted terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text

# How a numbered line begins, and the separators that may follow its mark.
MARK = re.compile(r"^\s*([0-9]{1,2}|I{2,4}|IV|VI{0,3}|IX|[A-Za-z])(.?)")
SEPARATORS = ".。,，、)）:：．]】"
LONGEST_SKIP = 4
ROMAN = {"I": 1, "II": 2, "III": 3, "IIII": 4, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}


class Open(NamedTuple):
    """A numbered line whose level is still open: the style and number of its mark, and its row."""

    style: str
    number: int
    row: int


def readings(mark: str) -> Iterator[tuple[str, int]]:
    """The ways to read a mark; I, V and X may be roman ones or letters."""
    if mark.isdigit():
        yield "arabic", int(mark)
        return
    if mark in ROMAN:
        yield "roman_upper", ROMAN[mark]
    if len(mark) == 1:
        yield ("letter_upper" if mark.isupper() else "letter_lower"), ord(mark.upper()) - 64


def place(levels: list[Open], mark: str, separated: bool) -> tuple[int, str, int, str] | None:
    """(depth, style, number, confidence) of a numbered line under the open levels; None if it is no numbered line.

    In this order: the number after that of an open level, innermost first; the first number of a new level; a number
    that skips at most LONGEST_SKIP; anything else with a separator, with low confidence. Without a separator only the
    first case holds, so that "10 Jan 2026" is text.
    """
    ways = list(readings(mark))
    innermost = range(len(levels), 0, -1)
    for style, number in ways:
        for depth in innermost:
            if levels[depth - 1][:2] == (style, number - 1):
                return depth, style, number, "high"
    if not separated or not ways:
        return None
    for style, number in ways:
        if number == 1:
            return len(levels) + 1, style, number, "high"
    for style, number in ways:
        for depth in innermost:
            if levels[depth - 1].style == style and 1 < number - levels[depth - 1].number <= LONGEST_SKIP:
                return depth, style, number, "high"
    style, number = ways[0]
    depth = next((d for d in innermost if levels[d - 1].style == style), len(levels) + 1)
    return depth, style, number, "low"


def segments_of(body: str) -> list[dict]:
    """Segments of one text; row 0 is the text before the first numbered line."""
    rows = [{"row": 0, "parent": None, "level": 0, "label": "", "style": "none", "heading": "", "content": [], "path": [], "confidence": "high"}]
    levels: list[Open] = []
    for line in body.splitlines():
        if not line.strip():
            continue
        found = MARK.match(line)
        after = (found.group(2) or "") if found else ""
        at = place(levels, found.group(1), after != "" and after in SEPARATORS) if found and (after in SEPARATORS or after.isspace()) else None
        if at is None:
            rows[-1]["content"].append(line)
            continue
        depth, style, number, confidence = at
        del levels[depth - 1 :]
        above = rows[levels[-1].row if levels else 0]
        levels.append(Open(style, number, len(rows)))
        rows.append({"row": len(rows), "parent": above["row"], "level": depth, "label": found.group(1), "style": style, "heading": line.strip(), "content": [], "path": above["path"] + [above["heading"]] * bool(above["heading"]), "confidence": confidence})
    for r in rows:
        r["content"] = "\n".join(r["content"])
    return rows


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, parent, level, label, style, heading, content, path, confidence): the numbered segments of each text.

    What a line is depends on all lines before it, so a text is read in order; texts are independent and stay whole in
    their Arrow batch.
    """
    columns = ["row", "parent", "level", "label", "style", "heading", "content", "path", "confidence"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, *(r[c] for c in columns)) for key, body in zip(batch[id_col], batch[text_col], strict=True) for r in segments_of(body or "")]
            frame = pd.DataFrame(out, columns=[id_col, *columns])
            yield frame.astype({"parent": "Int64"})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, row int, parent int, level int, label string, style string, heading string, content string, path array<string>, confidence string"
    return docs.select(id_col, text_col).mapInPandas(task, schema)


def grouped(found: DataFrame, budget: int = 800, id_col: str = "doc_id") -> DataFrame:
    """(id, group, context, n_segments, tokens): neighbouring segments of one path together, up to a token budget."""
    kind = found.schema[id_col].dataType.simpleString()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("row").itertuples():
            body = "\n".join(x for x in (r.heading, r.content) if x)
            if not body:
                continue
            tokens, context = int(len(body) / 2.5), " > ".join(r.path)
            if not out or out[-1][2] != context or out[-1][4] + tokens > budget:
                out.append([getattr(r, id_col), len(out), context, 0, 0])
            out[-1][3] += 1
            out[-1][4] += tokens
        return pd.DataFrame(out, columns=[id_col, "group", "context", "n_segments", "tokens"])

    return found.groupBy(id_col).applyInPandas(gather, f"`{id_col}` {kind}, group int, context string, n_segments int, tokens int")


def email_body(content):  # noqa: ANN001, ANN201
    """The newest part of a mail's text, without a closing of at most four lines that hold no content."""
    newest = F.element_at(F.split(content, r"(?m)^(?:>|On .+ wrote:|-{2,} ?Original Message|From: .*@)", 2), 1)
    closing = F.regexp_replace(newest, r"(?s)\n(?:Best regards|Regards|Thanks|Cheers),?[ \t]*(?:\n[^\n]{0,7}){0,3}\s*$", "")
    return F.btrim(closing, F.lit(" \n\r\t"))


def grounded(candidates: DataFrame, source: str = "raw_text", term: str = "term") -> DataFrame:
    """Candidates whose term is in the text but for case, blanks and forms that NFKC makes one. An empty term is in none."""
    marked = candidates.withColumns({"__body": text.compatible(F.col(source)), "__term": text.compatible(F.col(term))})
    return marked.filter((F.col("__term") != "") & F.contains("__body", "__term")).drop("__body", "__term")


def unique_terms(terms: DataFrame, term: str, order: str) -> DataFrame:
    """The first of terms that differ in case only."""
    first = terms.groupBy(text.folded_text(F.col(term)).alias("folded")).agg(F.min_by(term, order).alias(term))
    return first.select(term)
