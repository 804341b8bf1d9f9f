"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, per_worker, text_runs

#: A blank after a printable ASCII character. No pre-token of the byte-level pattern reaches from a visible
#: character into a blank, and the pattern looks at nothing before the token, so the text may be cut there.
SAFE_BOUNDARY = re.compile(r"[!-~](?=[ \n])")


def pieces_of(text: str, longest: int) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about `longest` characters; without a boundary it stays whole."""
    start = 0
    while len(text) - start > longest:
        found = SAFE_BOUNDARY.search(text, start + longest)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


class PieceCounter:
    """Counts by a sentencepiece model, whole texts at a time."""

    whole_texts = True

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


class FileCounter:
    """Counts by a tokenizers file, of whole texts or of safe pieces of them.

    A byte-level file is cut further into chunks, a word with the one blank or newline before it: between a visible
    character and a blank no pre-token goes on, and a blank that a visible character follows begins one. A text's
    count is then the sum of its chunks', and a chunk that came before need not be encoded again. Unseen chunks are
    encoded together: each begins with the only token in it that begins with a blank, which tells where it ends.
    Texts with other white space, or with several blanks in a row, are encoded as they are.
    """

    def __init__(self, path: str, most_bytes: int = 64 << 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        plain = all(not (t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in added)
        self.chunked = bool(byte_level and plain)
        self.whole_texts = not self.chunked
        if self.chunked:
            # the byte-level alphabet spells a blank and a newline as the 32nd and the 10th letter from U+0100 on
            names = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(names.values()) + 1, bool)
            self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)").search
            self.opens[[i for name, i in names.items() if name[:1] in (chr(0x120), chr(0x10A))]] = True
        #: chunk without its blank -> count, None for one of odd white space; the older half of the memory is in `before`
        self.fixed = {"": None, "\n": 1}
        #: more newlines than one before another blank are one pre-token
        self.runs = ("\n\n\n", "\n\n ")
        self.known, self.before, self.held, self.most = dict(self.fixed), {}, 0, most_bytes

    def count(self, texts: list[str]) -> list[int]:
        if not self.chunked:
            return self.encoded(texts)
        chunks = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [c.pop(0) for c in chunks]
        self.learn(set(filterfalse(self.known.__contains__, chain.from_iterable(chunks))))
        totals, whole = [0] * len(texts), []
        for i, (text, head, parts) in enumerate(zip(texts, heads, chunks, strict=True)):
            try:
                if any(x in text for x in self.runs) or text.endswith("\n\n") or head.split() != [head][: len(head)]:
                    whole.append(i)
                else:
                    totals[i] = sum(map(self.known.__getitem__, parts))
            except TypeError:
                whole.append(i)
        apart = set(whole)
        heads = {i: head for i, head in enumerate(heads) if head and i not in apart}
        for i, n in zip(heads, self.encoded([*heads.values()]), strict=True):
            totals[i] += n
        for i, n in zip(whole, self.encoded([texts[i] for i in whole]), strict=True):
            totals[i] = n
        if 2 * self.held > self.most:
            self.before, self.known, self.held = self.known, dict(self.fixed), 0
        return totals

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[str], at_once: int = 4_000) -> None:
        """Counts of chunks that are not known yet. A stop after a letter is a token by itself, so such a chunk has one
        more than its word."""
        self.held += sum(map(len, new)) + 120 * len(new)
        again = new & self.before.keys()
        self.known.update((x, self.before[x]) for x in again)
        new -= again
        stopped = [x for x in new if x[-1] in ".,:;!?" and x[-2:-1].isalpha()]
        new.difference_update(stopped)
        new.update(filterfalse(self.known.__contains__, (x[:-1] for x in stopped)))
        odd = [x for x in new if x.split() != [x.removeprefix("\n")] or self.special(x)]
        self.known.update(dict.fromkeys(odd))
        fresh = list(new.difference(odd))
        for start in range(0, len(fresh), at_once):
            part = fresh[start : start + at_once]
            (found,) = self.tokenizer.encode_batch_fast(["".join([x if x[0] == "\n" else " " + x for x in part])], add_special_tokens=False)
            at = np.flatnonzero(self.opens[np.array(found.ids)])
            self.known.update(zip(part, np.diff(at, append=len(found.ids)).tolist(), strict=True))
        for x in stopped:
            n = self.known[x[:-1]]
            self.known[x] = None if n is None else n + 1


def load_counter(tokenizer_path: str) -> PieceCounter | FileCounter:
    """What counts texts by the library that the file is for; special strings are handled as its default."""
    return PieceCounter(tokenizer_path) if tokenizer_path.endswith(".model") else FileCounter(tokenizer_path)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 16,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; one narrow stage, no shuffle.

    A null or empty text has 0 bytes and 0 tokens. Ids may be null or repeat: each row is counted by itself. An empty
    table gives no rows. Batches are runs of rows of about batch_bytes bytes of UTF-8, whatever their number of texts;
    texts longer than piece_chars are cut at safe boundaries, if the file is a byte-level one (others get whole texts).
    The tokenizer is loaded once in a Python worker. Other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("token counts", tokenizer_path), lambda: load_counter(tokenizer_path))
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for first, last, texts in text_runs(batch.column(1), batch_bytes):
                if counter.whole_texts or max(map(len, texts), default=0) <= piece_chars:
                    totals[first:last] = counter.count(texts)
                    continue
                pieces = [(row, piece) for row, text in enumerate(texts, first) for piece in pieces_of(text, piece_chars)]
                np.add.at(totals, [row for row, _ in pieces], counter.count([piece for _, piece in pieces]))
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(totals), pa.array(totals > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), task, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
