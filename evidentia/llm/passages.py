"""Substring dedup by relative Lempel-Ziv parsing: words of passages that an earlier document holds are removed.

A document is factored against the reference, which is all documents of smaller id. The reference is indexed block by
block (a block is a run of documents in a task), and the entries of all blocks meet in one index that is dealt by hash:
parsing each document against each block in turn would be quadratic. What is indexed are anchors, the k-grams of least
hash in a window. A window of `width` words has exactly one, at a place that its own words decide, so equal windows have
the same one at the same place, and a window whose anchor is in one document only is in one document only.

Where all occurrences of an anchor have the same words around them, the first document with the anchor is the source of
every window over it. Elsewhere the windows are looked up one by one. A factor goes on greedily as long as the next
window has the same source and the next place in it; every window across a factor's ends has been looked up by itself,
so no window of `width` words that a smaller document holds is missed, and nothing shorter is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, per_worker, text_runs, written
from .fingerprints import _sliding_min
from .shingles import U64, WordHashes, mixed

BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
FLIP, LOW = U64(0x5851F42D4C957F2D), U64(0xFFFFFFFF)


def gram_hashes(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each n consecutive values, put together from those of the powers of two that n is made of."""
    count = max(0, len(h) - n + 1)
    out, done, step, size, power, shift = np.zeros(count, U64), 0, h, 1, base, U64(1)
    while n:
        if n & 1:
            out = out + shift * step[done : done + count]
            done, shift = done + size, shift * power
        n >>= 1
        if n:
            step, power, size = step[:-size] + power * step[size:] if len(step) > size else step[:0], power * power, 2 * size
    return out


class Windows:
    """Anchors, contexts and hashes of the windows of a text's words."""

    def __init__(self, width: int, gram: int) -> None:
        self.width, self.gram, self.span = width, gram, width - gram
        self.hashes = WordHashes()

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.hashes) > self.hashes.most:
            self.hashes.clear()
        return np.fromiter(map(self.hashes.__getitem__, words), U64, len(words))

    def anchor_of_each(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each window's anchor, hashes of all k-grams); of several least ones the first is the anchor."""
        if len(h) < self.width:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        grams = mixed(gram_hashes(h, self.gram, BASES[0]))
        ranked = (grams & ~LOW) | np.arange(len(grams)).astype(U64)  # by the upper half, then by place
        return (_sliding_min(ranked, self.span + 1) & LOW).astype(np.int64), grams

    def contexts(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of all words that windows over an anchor can hold; what lies outside the text counts as zeros."""
        beyond = np.zeros(self.span, U64)
        return gram_hashes(np.concatenate((beyond, h, beyond)), self.gram + 2 * self.span, BASES[1])[at]

    def window_hashes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gram_hashes(h, self.width, BASES[0]), gram_hashes(mixed(h ^ FLIP), self.width, BASES[1])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchored(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(who, t, anchor, at, context) of all anchors of texts (who, t, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = per_worker(("passages", width, gram), lambda: Windows(width, gram))
        for batch in batches:
            for first, last, run in text_runs(batch.column(2)):
                places, keys, around = [], [], []
                with np.errstate(over="ignore"):
                    for text in run:
                        h = windows.word_hashes(text.encode().split())
                        at, grams = windows.anchor_of_each(h)
                        at = np.unique(at)
                        places.append(at)
                        keys.append(grams[at])
                        around.append(windows.contexts(h, at) if len(at) else grams)
                rows = np.repeat(np.arange(first, last), [len(x) for x in places])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), signed(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32)), signed(np.concatenate(around))], ["who", "t", "anchor", "at", "context"])

    return map_batches(texts, task, "who long, t long, anchor long, at int, context long")


def looked_up(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(who, t, at, h1, h2) of the windows whose anchor is at one of the text's `places`; texts: (who, t, text, places)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = per_worker(("passages", width, gram), lambda: Windows(width, gram))
        for batch in batches:
            for first, _, run in text_runs(batch.column(2), 1 << 20):
                starts, ones, twos = [], [], []
                with np.errstate(over="ignore"):
                    for i, text in enumerate(run, first):
                        h = windows.word_hashes(text.encode().split())
                        at, _ = windows.anchor_of_each(h)
                        start = np.flatnonzero(np.isin(at, batch.column(3)[i].values.to_numpy()))
                        one, two = windows.window_hashes(h)
                        starts.append(start)
                        ones.append(one[start])
                        twos.append(two[start])
                rows = pa.array(np.repeat(np.arange(first, first + len(run)), [len(x) for x in starts]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(starts).astype(np.int32)), signed(np.concatenate(ones)), signed(np.concatenate(twos))], ["who", "t", "at", "h1", "h2"])

    return map_batches(texts, task, "who long, t long, at int, h1 long, h2 long")


def factors_of(start: np.ndarray, end: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, source, place) of the factors that stretches of known source make up, by start.

    place is that of a stretch's start in its source. Stretches that overlap or touch and go on at the same distance in
    the same source are one factor.
    """
    order = np.lexsort((start, place - start, source))
    start, end, source, place = start[order], end[order], source[order], place[order]
    if not len(start):
        return start, end, source, place
    new = np.ones(len(start), bool)
    new[1:] = (source[1:] != source[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1])
    # furthest end so far in each run of one source and distance
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = start[first], np.maximum.reduceat(end, first), source[first], place[first]
    by_start = np.lexsort((out[1], out[0]))
    return tuple(x[by_start] for x in out)


def spans_of(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(who, t, stretches): of each text the stretches of words that a document of smaller id holds too, with (source, place)."""
    around = width - gram
    anchors = written(anchored(texts, width, gram), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min(F.struct("who", "at")).alias("first"), F.max("who").alias("last"), (F.min("context") == F.max("context")).alias("uniform"))
    # written, so that both sides of the join have exchanges of their own, which Spark splits where a key is hot
    shared = written(shared.filter(F.col("first.who") < F.col("last")).select("anchor", "uniform", F.col("first.who").alias("source"), F.col("first.at").alias("place")), "shared-anchors")
    met = written(anchors.select("who", "t", "anchor", "at").join(shared, "anchor").filter("not uniform or who > source"), "met")
    discard(anchors, shared)
    # the windows over an anchor whose surroundings are the same everywhere
    begin = F.greatest(F.col("at") - around, F.lit(0))
    plain = met.filter("uniform").select("who", "t", F.struct(begin.alias("start"), (F.col("at") + gram + around).alias("end"), "source", (F.col("place") - F.col("at") + begin).alias("place")).alias("s"))
    # others one by one
    varied = met.filter("not uniform").groupBy("who", "t").agg(F.collect_set("at").alias("places"))
    windows = written(looked_up(texts.join(varied, ["who", "t"]).select("who", "t", "text", "places"), width, gram), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("who", "at")).alias("first"), F.max("who").alias("last"))
    firsts = written(firsts.filter(F.col("first.who") < F.col("last")).select("h1", "h2", "first"), "first-windows")
    found = windows.join(firsts, ["h1", "h2"]).filter(F.col("who") > F.col("first.who"))
    single = found.select("who", "t", F.struct(F.col("at").alias("start"), (F.col("at") + width).alias("end"), F.col("first.who").alias("source"), F.col("first.at").alias("place")).alias("s"))
    spans = written(plain.unionByName(single).groupBy("who", "t").agg(F.collect_set("s").alias("stretches")), "spans")
    discard(met, windows, firsts)
    return spans


def drop_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept, factors) for each row: the words that no duplicate window covers, joined by blanks.

    A window is `width` consecutive words (between ASCII blanks, unchanged) of one text. Words go if a window over them
    also starts in a document of smaller id; windows are judged on the input. factors tell where the duplicate stretches
    begin and end (in words) and where they stand in the source, a document of smaller id; in the source's last words a
    factor's end may lie behind the text's, as stretches are cut at their own text only. Null and empty texts have no words. Rows of
    one id are one document, so they never take from one another; a null id is below all others. Repeated rows share
    their fate. An empty table gives no rows; other columns are not read.

    Anchors are 2 in 32 words with the default widths, 36 bytes each. Counting them and the windows is combined before
    the shuffle, so a passage that a third of all documents hold is a few rows there, and both joins are on equality
    with one row a key on one side, which Spark splits where a key is hot. Windows are compared by 128 bits of hash,
    surroundings of an anchor by its 64 and 64 of theirs.
    """
    who = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    base = docs.select(F.col(id_col).alias("doc"), who.alias("who"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    spans = spans_of(base.select("who", "t", "text"), width, gram)
    joined = base.join(spans, ["who", "t"], "left").select("doc", "text", "stretches")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("place", pa.int32())]))]
        for batch in batches:
            for first, last, run in text_runs(batch.column(1)):
                out = []
                for i, text in enumerate(run, first):
                    words, cell = text.encode().split(), batch.column(2)[i]
                    if not cell.is_valid:
                        out.append((len(words), 0, b" ".join(words), []))
                        continue
                    start, end, source, place = factors_of(*(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in cell.values.flatten()))
                    end = np.minimum(end, len(words))
                    edge = np.bincount(start, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    kept = [words[j] for j in np.flatnonzero(~gone)]
                    out.append((len(words), int(gone.sum()), b" ".join(kept), [{"start": a, "end": b, "source": c, "place": d} for a, b, c, d in zip(start.tolist(), end.tolist(), source.tolist(), place.tolist(), strict=True)]))
                columns = [pa.array([x.decode() for x in c] if k == 2 else c, kinds[k]) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], ["doc", "n_words", "n_removed", "kept", "factors"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(joined, task, f"doc {kind}, n_words long, n_removed long, kept string, factors array<struct<start:int,end:int,source:long,place:int>>")
    return made.withColumnRenamed("doc", id_col)


def passage_digest(dropped: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of what drop_passages returns."""
    return dropped.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


PASSAGES_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words) - 49)) AS begins, words FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, begins, md5(array_to_string(words[begins + 1 : begins + 50], ' ')) AS hash FROM w),
f AS (SELECT hash, min(doc_id) AS earliest FROM h GROUP BY hash HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT DISTINCT h.doc_id, h.begins + k AS pos FROM h JOIN f USING (hash), range(50) t(k) WHERE h.doc_id > f.earliest),
tok AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
kept AS (SELECT tok.doc_id, count(bad.pos) AS n_removed, string_agg(word, ' ' ORDER BY tok.pos) FILTER (WHERE bad.pos IS NULL) AS kept FROM tok LEFT JOIN bad ON bad.doc_id = tok.doc_id AND bad.pos = tok.pos GROUP BY tok.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
