"""Alignment of two tokenizers: groups between common byte cuts, links within groups, and how many documents hold a link."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, per_worker, text_runs, written

#: Signs that end many words, and the letters before them: no piece goes on from such a letter into such a sign.
STOPS, LETTERS = ".,:;!?$#&*%", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: A word with the blank or newline before it, signs right behind such a word, or any stretch that begins with a blank or
#: newline behind a visible character (or with the text) and ends before the next such place. Neither the byte-level
#: pattern nor a piece goes on from a visible character into a blank.
CHUNK = re.compile(rf"[ \n][{LETTERS}]+(?=[{STOPS}]*(?:[ \n]|\Z))|[{STOPS}]+|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
SHIFT = 32  # a pair of ids is one number, the first tokenizer's id in the upper half


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """Ids of a byte-level file (A) and of a piece model (B), and the bytes that each id stands for."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters, names = byte_alphabet(), self.a.get_vocab()
        bytes_a = {i: bytes(map(letters.__getitem__, name)) if all(c in letters for c in name) else name.encode() for name, i in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a, default=-1) + 1)]
        self.bytes_b = bytes_b
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64)
        #: chunks are encoded apart only if no piece goes on over one of their ends, or holds a newline
        over = re.compile(rf"[^▁]▁|\n|[{LETTERS}][{STOPS}]").search
        self.cuts = not any(over(p) for i, p in enumerate(pieces) if not self.b.is_byte(i)) and bool((self.size_a > 0).all() and (self.size_b > 0).all())
        self.opener = self.b.piece_to_id("▁")

    def chunks(self, text: str) -> list[str]:
        """Of the text behind a blank."""
        return CHUNK.findall(" " + text) if self.cuts else [" " + text]

    def encode(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of one chunk by A and by B. B puts a blank before what it is given: the chunk's own, or one that goes again,
        with the newline that keeps it apart."""
        (first,) = self.a.encode_batch_fast([chunk], add_special_tokens=False)
        if chunk == " ":  # nothing would be given, so no blank would be put before it
            return first.ids, [self.opener]
        return first.ids, self.b.encode(chunk[1:]) if chunk[0] == " " else self.b.encode("\n" + chunk)[2:]

    def encode_joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of chunks that may stand one behind another, or None if they do not spell them."""
        whole = " a" + "".join(chunks)
        (first,) = self.a.encode_batch_fast([whole], add_special_tokens=False)
        second = self.b.encode(whole[1:])
        if not b"".join(map(self.bytes_a.__getitem__, first.ids)) == whole.encode() == b"".join(map(self.bytes_b.__getitem__, second)):
            return None
        ids = [np.array(x, np.int64) for x in (first.ids, second)]
        return tuple(x[np.cumsum(size[x]) > 2] for x, size in zip(ids, (self.size_a, self.size_b), strict=True))


def aligned(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group labels of the tokens of both sides, from their byte lengths: a group ends where tokens of both end."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def links_of(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, group) of all links: each token of A once for every token of B in its group."""
    n_b = np.bincount(group_b, minlength=int(group_a[-1]) + 1 if len(group_a) else 0)
    start_b = np.concatenate(([0], np.cumsum(n_b)[:-1])) if len(n_b) else n_b
    times = n_b[group_a]
    total = int(times.sum())
    # place of each link within the links of its token of A
    within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    partner = ids_b[np.repeat(start_b[group_a], times) + within]
    return (np.repeat(ids_a, times) << SHIFT) | partner, np.repeat(group_a, times)


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted rows begin to differ from the one before."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Lexicon:
    """What is known of chunks, by number: token, group and link counts, the groups written out, the pairs.

    Common cuts lie at all chunk ends, so a document's groups are its chunks' in turn. Beyond most_bytes the chunks that
    came least often since the last time are forgotten, which changes no result.
    """

    #: what ends a token in the groups written out: within a side, between sides, between groups, at a chunk's end
    ENDS = (",", "|", ";", "\0")

    def __init__(self, encoders: Encoders, most_bytes: int = 110 << 20) -> None:
        self.encoders, self.most = encoders, most_bytes
        n = max(len(encoders.bytes_a), len(encoders.bytes_b))
        self.spelt = [f"{i}{end}" for end in self.ENDS for i in range(n)]
        self.ids = n
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes are the chunk's
        self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair_start, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        often = np.argsort(-self.uses, kind="stable")
        keep = np.sort(often[np.cumsum(self.sizes[often]) <= self.most // 2])
        names = [*self.number]
        self.number = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.groups = [self.groups[i] for i in keep.tolist()]
        n = np.diff(self.pair_start)[keep]
        where = stretches(self.pair_start[keep], n)
        self.pairs, self.times = self.pairs[where], self.times[where]
        self.pair_start = np.concatenate(([0], np.cumsum(n)))
        self.counts, self.sizes, self.uses = self.counts[keep], self.sizes[keep], np.zeros(len(keep), np.int64)

    def learn(self, new: list[str], at_once: int = 3_000) -> None:
        joinable = [c for c in new if c[0] in " \n" and not c[-1].isspace()] if self.encoders.cuts else []
        for at in range(0, len(joinable), at_once):
            self.learn_joined(joinable[at : at + at_once])
        for c in [c for c in new if c not in self.number]:
            ids_a, ids_b = (np.array(x, np.int64) for x in self.encoders.encode(c))
            e = self.encoders
            if b"".join(map(e.bytes_a.__getitem__, ids_a)) == c.encode() == b"".join(map(e.bytes_b.__getitem__, ids_b)):
                self.add([c], ids_a, ids_b)
            else:
                self.append([c], np.zeros((1, 5), np.int64), [""], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def learn_joined(self, chunks: list[str]) -> None:
        """Chunks that follow one another as one text, halved until those that are not spelt by their tokens are alone."""
        found = self.encoders.encode_joined(chunks)
        if found:
            self.add(chunks, *found)
        elif len(chunks) > 1:
            self.learn_joined(chunks[: len(chunks) // 2])
            self.learn_joined(chunks[len(chunks) // 2 :])

    def add(self, chunks: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Take up chunks whose tokens follow one another and spell them."""
        e = self.encoders
        group_a, group_b = aligned(e.size_a[ids_a], e.size_b[ids_b])
        pair, of_group = links_of(ids_a, ids_b, group_a, group_b)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        chunk_a, chunk_b = (np.searchsorted(ends, np.cumsum(size[ids])) for ids, size in ((ids_a, e.size_a), (ids_b, e.size_b)))
        n_groups = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        chunk_of = chunk_a[np.cumsum(in_a) - 1]
        owner = chunk_of[of_group]
        counts = np.stack([np.bincount(x, minlength=len(chunks)) for x in (chunk_a, chunk_b, chunk_of, owner)] + [np.ones(len(chunks), np.int64)], 1)
        # tokens in the order they are written out: a group's of A, then its of B
        start = np.cumsum(in_a + in_b) - in_a - in_b
        at_a = start[group_a] + np.arange(len(ids_a)) - (np.cumsum(in_a) - in_a)[group_a]
        at_b = (start + in_a)[group_b] + np.arange(len(ids_b)) - (np.cumsum(in_b) - in_b)[group_b]
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        order[at_a], order[at_b] = ids_a, ids_b
        end = np.zeros(len(order), np.int64)
        end[start + in_a - 1] = 1
        end[start + in_a + in_b - 1] = np.where(np.diff(chunk_of, append=len(chunks)) > 0, 3, 2)
        spelt = "".join(map(self.spelt.__getitem__, (end * self.ids + order).tolist())).split("\0")[:-1]
        # a chunk's distinct pairs with how often they are linked in it
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        first = first_of_each(pair, owner)
        self.append(chunks, counts, spelt, np.bincount(owner[first], minlength=len(chunks)), pair[first], np.diff(first, append=len(pair)))

    def append(self, chunks: list[str], counts: np.ndarray, groups: list[str], n_pairs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += groups
        self.counts = np.concatenate((self.counts, counts))
        self.uses = np.concatenate((self.uses, np.zeros(len(chunks), np.int64)))
        self.sizes = np.concatenate((self.sizes, np.fromiter((2 * len(c) + len(g) + 300 for c, g in zip(chunks, groups, strict=True)), np.int64, len(chunks)) + 16 * n_pairs))
        self.pair_start = np.concatenate((self.pair_start, self.pair_start[-1] + np.cumsum(n_pairs)))
        self.pairs, self.times = np.concatenate((self.pairs, pairs)), np.concatenate((self.times, times))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, groups_sha256, place where each text's pairs begin, pairs, times) of texts."""
        if int(self.sizes.sum()) > self.most:
            self.forget()
        found = [self.encoders.chunks(t) if t else [] for t in texts]
        self.learn([*dict.fromkeys(filterfalse(self.number.__contains__, chain.from_iterable(found)))])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        listed = [*map(self.number.__getitem__, chain.from_iterable(found))]
        owner, at = np.repeat(np.arange(len(texts)), lengths), np.array(listed, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        bad = np.bincount(owner[self.counts[at, 4] == 0], minlength=len(texts)) > 0
        totals = np.stack([np.bincount(owner, weights=self.counts[at, k], minlength=len(texts)) for k in range(4)], 1).astype(np.int64)
        totals[bad] = 0
        ends = np.cumsum(lengths).tolist()
        hashes = ["" if bad[i] or not found[i] else hashlib.sha256(";".join(map(self.groups.__getitem__, listed[end - len(found[i]) : end])).encode()).hexdigest() for i, end in enumerate(ends)]
        # distinct chunks of a text with how often they come, then its distinct pairs
        keys = np.sort(((owner << 40) | at)[~bad[owner]])
        first = first_of_each(keys)
        often, seen = np.diff(first, append=len(keys)), keys[first]
        owner, at = seen >> 40, seen & ((1 << 40) - 1)
        n = self.pair_start[at + 1] - self.pair_start[at]
        where = stretches(self.pair_start[at], n)
        pair, times, owner = self.pairs[where], self.times[where] * np.repeat(often, n), np.repeat(owner, n)
        order = np.lexsort((pair, owner))
        pair, times, owner = pair[order], times[order], owner[order]
        first = first_of_each(pair, owner)
        times = np.add.reduceat(times, first) if len(first) else times
        return totals, hashes, np.searchsorted(owner[first], np.arange(len(texts) + 1)), pair[first], times


def stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of n each, one stretch after another."""
    return np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


NAMES = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def linked_documents(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = 1 << 20) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for each row; one narrow stage.

    pairs are the text's distinct linked id pairs (A's id * 2**32 + B's), times how often each is linked. Null and empty
    texts, and those whose tokens do not spell them, have zeros, an empty hash and no pairs. Work goes by runs of about
    run_bytes; a chunk's tokens, groups and pairs are kept in the worker within a bound of bytes, so that a chunk that
    came before is not encoded again. Other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = per_worker(("alignment", byte_file, piece_file), lambda: Lexicon(Encoders(byte_file, piece_file)))
        for batch in batches:
            for first, last, texts in text_runs(batch.column(1), run_bytes):
                totals, hashes, start, pairs, times = lexicon.documents(texts)
                offsets = pa.array(start, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *[pa.array(totals[:, k]) for k in range(4)], pa.array(hashes, pa.string()), *lists], NAMES)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), task, f"doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame, salts: int = 16) -> DataFrame:
    """(pair, a, count): in how many documents (rows) a pair is linked; a is its A id.

    Pairs are counted in two shuffled stages, first by pair and salt and then by pair, each combined before its shuffle,
    so a pair that every document holds is a few rows.
    """
    single = linked.select(F.explode("pairs").alias("pair"), F.pmod(F.col("row"), F.lit(salts)).alias("salt"))
    counts = single.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    return counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), "count")


def with_best(counts: DataFrame) -> DataFrame:
    """(pair, count, best): whether no other pair of the A id is in more documents; a combined maximum by A id."""
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_file: str, piece_file: str, *, id_col: str = "doc_id", text_col: str = "text", most_hot: int = 400_000) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    Rows count as documents, whatever their ids, which may be null or repeat. Texts that are null, empty or not spelt by
    their tokens have zeros and ''. An empty table gives no rows.

    Counts come back to documents by pair. Pairs in more than 1/most_hot of all (document, pair) rows are fewer than
    most_hot, which bounds what is broadcast (17 bytes a row); the others, none of which is hot, are joined by shuffle.
    """
    # the number of a written row tells rows of one id apart
    linked = written(linked_documents(docs, byte_file, piece_file, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "linked")
    counts = written(pair_counts(linked), "pair-counts")
    counted = written(with_best(counts), "pair-best")
    discard(counts)
    total = counted.agg(F.sum("count")).first()[0] or 0
    is_hot = F.col("count") * most_hot > total
    rows = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = F.broadcast(counted.filter(is_hot).select("pair", "count", "best"))
    met = rows.join(hot, "pair", "left")
    # what a row's hot pairs give is summed in its task; only rare pairs go through the shuffle
    rare = met.filter("count is null").select("row", "pair", "times").join(counted.filter(~is_hot), "pair")
    parts = met.filter("count is not null").select("row", "times", "count", "best").unionByName(rare.select("row", "times", "count", "best"))
    sums = parts.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    joined = linked.drop("pairs", "times").join(sums, "row", "left")
    return joined.select(F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
