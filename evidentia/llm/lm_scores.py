"""LM scoring by deleted interpolation; counts are gathered and looked up by shuffles of packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_of, map_batches, per_worker, text_runs, written
from .shingles import U64, WordHashes, mixed, words_of

#: Keys of the end token and of the context before the first word; a word's hash is one of them by accident only.
END, BEGIN = 0x9D5C3A1F00000001, 0x9D5C3A1F00000003
#: Buckets of context frequency: powers of two of how often a context was seen, the first for never.
BUCKETS = 32
#: Steps in which EM sees log2 of how an estimate compares with the uniform one; 0 is for an estimate of zero.
STEP, REACH = 4, 512


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers packed byte place by byte place, as their upper bytes are mostly equal."""
    return packed(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def numbers(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def steps(x: np.ndarray) -> bytes:
    """Numbers packed as differences, for sorted ones."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def sorted_numbers(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(numbers(data, kind), dtype=kind)


def ranked(x: np.ndarray) -> tuple[bytes, bytes]:
    """Whole numbers that repeat: the distinct ones, most frequent first, and each one's place among them."""
    distinct, place, times = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return planes(distinct[order].astype(U64)), planes(rank[place])


def unranked(distinct: bytes, place: bytes) -> np.ndarray:
    return numbers(distinct)[numbers(place, "<u4")].astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1) * (count > 0)


class Batch:
    """Tokens of some documents as places in a list of word hashes, and their distinct (context, word) pairs.

    The pairs are not kept: they follow from the tokens, in the same order each time, so that counts can be asked for
    and given back as plain arrays.
    """

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> None:
        self.vocabulary, self.tokens, self.lengths, self.held = vocabulary, tokens, lengths, held
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[self.starts] = len(vocabulary)  # BEGIN
        self.training = np.repeat(~held, lengths)
        codes = before * (len(vocabulary) + 1) + tokens
        self.pairs, self.pair_of = np.unique(codes, return_inverse=True)
        self.contexts, self.words = np.divmod(self.pairs, len(vocabulary) + 1)

    def keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            named = np.append(self.vocabulary, U64(BEGIN))
            return mixed(named[self.contexts] * U64(0x9E3779B97F4A7C15) + self.vocabulary[self.words])

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.vocabulary))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.training], minlength=len(self.pairs))


def dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by bucket and key, edges of the buckets in that order); a bucket is the key's upper bits."""
    order = np.argsort(keys)
    edges = np.searchsorted(keys[order] >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)) if bits else np.array([0, len(keys)])
    return order, edges


def batches_of(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int, batch_chars: int) -> DataFrame:
    """One row for each run of documents of about batch_chars characters within a task."""

    def row(number: int, ids: list, held: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts], np.int64)
        vocabulary, place = np.unique(np.concatenate(parts), return_inverse=True)
        # frequent words get small numbers, which pack well; words of one frequency stay sorted by hash
        order = np.argsort(-np.bincount(place), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        data = [number, ids, packed(np.array(held, bool)), packed(lengths), steps(vocabulary[order]), planes(rank[place])]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([d], k) for d, k in zip(data, kinds, strict=True)], ["batch", "ids", "held", "lengths", "vocabulary", "tokens"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker(("word hashes",), WordHashes)
        number, size = TaskContext.get().partitionId() << 24, 0
        ids, held, parts = [], [], []
        for batch in batches:
            texts = (t for _, _, run in text_runs(batch.column(2)) for t in run)
            for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = words_of(text)
                h = np.empty(len(words) + 1, U64)
                h[:-1] = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
                h[-1] = END
                ids.append(key)
                held.append(out)
                parts.append(h)
                size += len(text) + 8
                if size >= batch_chars:
                    yield row(number, ids, held, parts)
                    number, size = number + 1, 0
                    ids, held, parts = [], [], []
            if len(hashes) > hashes.most:
                hashes.clear()
        if parts:
            yield row(number, ids, held, parts)

    key = F.col(id_col).cast("long")
    source = docs.select(key.alias("id"), (fold_of(key, folds) == held_fold).alias("held"), F.col(text_col).alias("text"))
    return map_batches(source, task, "batch long, ids array<long>, held binary, lengths binary, vocabulary binary, tokens binary")


def load(held: bytes, lengths: bytes, vocabulary: bytes, tokens: bytes) -> Batch:
    return Batch(sorted_numbers(vocabulary), numbers(tokens, "<u4").astype(np.int64), unpacked(lengths, "<i8"), unpacked(held, "?"))


def requests_of(batches: DataFrame, bits: int) -> DataFrame:
    """(bucket, batch, words, word_counts, pairs, pair_counts): a batch's keys in each bucket (a key's upper `bits` bits)
    with its own training counts."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows:
            for number, *blobs in zip(*(c.to_pylist() for c in group.columns), strict=True):
                b = load(*blobs)
                cols: list[list] = [[], []]
                for keys, counts in ((mixed(b.vocabulary), b.word_counts()), (b.keys(), b.pair_counts())):
                    order, edges = dealt(keys, bits)
                    k, n = keys[order], counts[order].astype(U64)
                    cols.append([steps(k[x:y]) for x, y in zip(edges, edges[1:], strict=False)])
                    cols.append([planes(n[x:y]) for x, y in zip(edges, edges[1:], strict=False)])
                cols[0], cols[1] = list(range(1 << bits)), [number] * (1 << bits)
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "batch", "words", "word_counts", "pairs", "pair_counts"])

    return map_batches(batches.select("batch", "held", "lengths", "vocabulary", "tokens"), task, REQUEST)


def summed(keys: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each part's sorted keys; the distinct keys of all parts, sorted, with their summed counts."""
    lists = [sorted_numbers(data) for data in keys]
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([numbers(c) for c in counts]).astype(np.float64), minlength=len(distinct))
    return lists, distinct, total.astype(U64)


def handed(lists: list[np.ndarray], distinct: np.ndarray, total: np.ndarray) -> list[bytes]:
    """The totals of each part's keys, in the order of its keys."""
    return [planes(total[np.searchsorted(distinct, x)]) for x in lists]


def replies_of(requests: DataFrame) -> DataFrame:
    """(batch, bucket, words, pairs, distinct, total): totals over all batches for the keys that each batch asked about."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        words, pairs = (summed(group[k].tolist(), group[c].tolist()) for k, c in (("words", "word_counts"), ("pairs", "pair_counts")))
        first = np.arange(len(group)) == 0
        return pd.DataFrame({"batch": group["batch"], "bucket": group["bucket"], "words": handed(*words), "pairs": handed(*pairs), "distinct": first * int((words[2] > 0).sum()), "total": first * int(words[2].sum())})

    return requests.groupBy("bucket").applyInPandas(answer, REPLY)


REPLY = "batch long, bucket long, words binary, pairs binary, distinct long, total long"
REQUEST = "bucket long, batch long, words binary, word_counts binary, pairs binary, pair_counts binary"


def exchanged(requests: DataFrame, askers: int, used: int, levels: list[int], gathered: int) -> tuple[DataFrame, list[DataFrame]]:
    """Replies to requests whose buckets are the upper `used` bits of keys, by way of further `levels` of bits; and the
    written tables that they are read from.

    With none left a bucket is small enough for one task. Else about `gathered` askers of a bucket are put together:
    their distinct keys with summed counts are one request, cut by the next bits, and its reply is dealt back to them.
    Keys are shuffled once to be put together; what is kept for dealing is each asker's places among the distinct keys,
    about a byte a key. A request is a bounded number of rows for each asker on every level, so rows grow with the input
    and no faster.
    """
    if not levels:
        return replies_of(requests), []
    bits, together = levels[0], -(-askers // gathered)
    asker = F.pmod(F.xxhash64("batch"), F.lit(together)).alias("asker")

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket, asker = int(key[0]), int(key[1])
        buckets = (bucket << bits) + np.arange(1 << bits)
        onward = {"onward": True, "bucket": buckets, "batch": asker}
        kept = {"onward": False, "bucket": group["bucket"], "batch": group["batch"]}
        for k, c in (("words", "word_counts"), ("pairs", "pair_counts")):
            lists, distinct, total = summed(group[k].tolist(), group[c].tolist())
            edges = np.append(np.searchsorted(distinct >> U64(64 - used - bits), buckets.astype(U64)), len(distinct))
            spans = [*zip(edges, edges[1:], strict=False)]
            onward[k], onward[c] = [steps(distinct[x:y]) for x, y in spans], [planes(total[x:y]) for x, y in spans]
            kept[k] = [steps(np.searchsorted(distinct, x).astype(np.uint32)) for x in lists]
        return pd.concat([pd.DataFrame(onward), pd.DataFrame(kept | {"word_counts": None, "pair_counts": None})])

    def deal(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("bucket")
        out = {"batch": group["batch"], "bucket": group["bucket"]}
        for k in ("words", "pairs"):
            total = np.concatenate([numbers(x) for x in found[k]])
            out[k] = [planes(total[sorted_numbers(x, "<u4")]) for x in group[k]]
        first = np.arange(len(group)) == 0
        return pd.DataFrame(out | {"distinct": first * int(found["distinct"].sum()), "total": first * int(found["total"].sum())})

    merged = written(requests.select("*", asker).groupBy("bucket", "asker").applyInPandas(merge, f"onward boolean, {REQUEST}"), "requests")
    below, tables = exchanged(merged.filter("onward").drop("onward"), together, used + bits, levels[1:], gathered)
    back = below.withColumn("of_bucket", F.shiftright("bucket", bits))
    kept = merged.filter("not onward").select("bucket", "batch", "words", "pairs", asker)
    return kept.groupBy("bucket", "asker").cogroup(back.groupBy("of_bucket", "batch")).applyInPandas(deal, REPLY), [merged, *tables]


def counts_for(b: Batch, replies: pd.DataFrame, bits: int) -> list[np.ndarray]:
    """Training counts (of words; of pairs) from the replies to a batch."""
    replies = replies.sort_values("bucket")
    found = []
    for keys, column in ((mixed(b.vocabulary), "words"), (b.keys(), "pairs")):
        order, _ = dealt(keys, bits)
        counts = np.empty(len(keys), np.int64)
        counts[order] = np.concatenate([numbers(x) for x in replies[column]]).astype(np.int64)
        found.append(counts)
    return found


def estimates(words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray, n: int, less: int) -> tuple[np.ndarray, ...]:
    """(bucket, bigram estimate, unigram estimate) from the counts of word, pair and context among n tokens; `less` 1 leaves
    the token itself out of all counts."""
    context = contexts - less
    bigram = np.where(context > 0, (pairs - less) / np.maximum(context, 1), 0.0)
    unigram = (words - less) / max(n - less, 1)
    return context_bucket(np.maximum(context, 0)), np.maximum(bigram, 0), np.maximum(unigram, 0)


def level(share: np.ndarray) -> np.ndarray:
    """An estimate's ratio to the uniform one in steps of log2; 0 for none."""
    with np.errstate(divide="ignore"):
        steps = np.rint(np.log2(share) * STEP)
    return np.where(share > 0, np.clip(np.nan_to_num(steps, neginf=0), 1 - REACH, REACH - 1) + REACH, 0).astype(np.int64)


def learn_weights(rows: list[tuple[int, int, int, float]], rounds: int = 60) -> np.ndarray:
    """EM on deleted counts: weights (bucket, [uniform, unigram, bigram]) from (bucket, unigram level, bigram level, n)."""
    weights = np.tile([0.2, 0.4, 0.4], (BUCKETS, 1))
    if not rows:
        return weights
    data = np.array(rows, np.float64)
    bucket = data[:, 0].astype(int)
    ratio = np.ones((len(data), 3))
    for j in (1, 2):
        ratio[:, j] = np.where(data[:, j] > 0, 2.0 ** ((data[:, j] - REACH) / STEP), 0)
    for _ in range(rounds):
        share = weights[bucket] * ratio
        share *= (data[:, 3] / share.sum(1))[:, None]
        summed = np.stack([np.bincount(bucket, weights=share[:, j], minlength=BUCKETS) for j in range(3)], axis=1)
        # one token's worth of the uniform start keeps every weight above zero, so unseen words have a probability
        summed += np.array([0.2, 0.4, 0.4])
        weights = summed / summed.sum(1, keepdims=True)
    return weights


#: A batch's row when it has met its replies: counts in the order of its tokens, and its part of EM's histogram.
COUNTED = {"ids": "array<long>", "held": "binary", "lengths": "binary"} | dict.fromkeys(("words", "word_places", "pairs", "pair_places"), "binary") | {"cells": "array<long>", "cell_n": "array<double>"}
SCORED = {"id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    batch_chars: int = 6_000_000,
    bucket_bytes: int = 12_000_000,
    level_bits: int = 12,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Tokens are words between ASCII blanks, A-Z lower-cased, and one end. The model mixes the maximum-likelihood bigram
    and unigram estimates and the uniform 1 / (V + 1), by weights for each bucket of context frequency. The weights are
    learned by EM on deleted counts: every training token is held out in turn, by taking it out of the counts that
    predict it. score is log10 of the text's probability; base_score is that of the add-one unigram model. Rows whose
    crc32 of the id modulo `folds` is held_fold are scored only, never counted.

    Documents are packed into batches of about batch_chars characters; a batch asks for the counts of its distinct
    words and pairs once. Requests are shuffled by key range, summed, and answered in the order they were asked, so
    every count is over all training rows and no table of counts meets in the driver or in one task. The ranges are
    set so that one gets about bucket_bytes of text's keys. A batch asks in at most 2**level_bits ranges (rows of some
    two kilobytes and more); where that leaves ranges too large, requests go through further levels (see exchanged), so
    that rows are in proportion to the input at any size. Batches meet their replies once: what is written then is the
    counts in the order of the tokens, from which EM's histogram and the scores are read without a shuffle. The driver
    gets two sums and a histogram of bounded size. EM sees estimates as ratios to the uniform one, rounded to a quarter
    of their log2.

    Null and empty texts are one end token. Null ids count as training rows, rows of the same id are separate
    documents. An empty table gives no rows. Other columns are not read.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    batches = written(batches_of(docs, id_col, text_col, folds, held_fold, batch_chars), "batches")
    levels = -(-bits // level_bits) or 1
    widths = [bits * (i + 1) // levels - bits * i // levels for i in range(levels)]
    found, tables = exchanged(requests_of(batches, widths[0]), batches.count(), widths[0], widths[1:], 1 << widths[0])
    replies = written(found, "counts")
    if tables:
        discard(*tables)
    sums = replies.agg(F.sum("total"), F.sum("distinct")).first()
    n, distinct = (sums[0] or 0), (sums[1] or 0)
    key = F.col(id_col).cast("long")
    begins = docs.filter(fold_of(key, folds) != held_fold).count()
    uniform = 1.0 / (distinct + 1)

    def counted(row: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        r = row.iloc[0]
        b = load(r["held"], r["lengths"], r["vocabulary"], r["tokens"])
        words, pairs = counts_for(b, found, widths[0])
        # every training token but the end is a context as often as it is a token; BEGIN is one for each training document
        contexts = np.append(words, begins)[b.contexts]
        times = b.pair_counts()
        seen = np.flatnonzero(times)
        bucket, bigram, unigram = estimates(words[b.words[seen]], pairs[seen], contexts[seen], n, 1)
        cells = (bucket * 2 * REACH + level(unigram / uniform)) * 2 * REACH + level(bigram / uniform)
        cells, at = np.unique(cells, return_inverse=True)
        cell_n = np.bincount(at, weights=times[seen], minlength=len(cells))
        cols = [r["ids"], r["held"], r["lengths"], *ranked(words[b.tokens]), *ranked(pairs[b.pair_of]), cells, cell_n]
        return pd.DataFrame({name: [x] for name, x in zip(COUNTED, cols, strict=True)})

    asked = batches.groupBy("batch").cogroup(replies.select("batch", "bucket", "words", "pairs").groupBy("batch"))
    counts = written(asked.applyInPandas(counted, ", ".join(f"{k} {v}" for k, v in COUNTED.items())), "token_counts")
    discard(batches, replies)
    histogram = counts.select(F.explode(F.arrays_zip("cells", "cell_n")).alias("c")).groupBy("c.cells").agg(F.sum("c.cell_n").alias("n")).orderBy("cells").collect()
    rows = [(c // (4 * REACH * REACH), c // (2 * REACH) % (2 * REACH), c % (2 * REACH), m) for c, m in histogram]
    weights = learn_weights(rows)

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows:
            for i in range(group.num_rows):
                ids, *blobs = (c[i] for c in group.columns)
                held, lengths, *ranks = (x.as_py() for x in blobs)
                held, lengths = unpacked(held, "?"), unpacked(lengths, "<i8")
                words, pairs = unranked(*ranks[:2]), unranked(*ranks[2:])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                contexts = np.append(0, words[:-1])
                contexts[starts] = begins
                bucket, bigram, unigram = estimates(words, pairs, contexts, n, 0)
                w = weights[bucket]
                model = np.log10(w[:, 0] * uniform + w[:, 1] * unigram + w[:, 2] * bigram)
                base = np.log10((words + 1) / (n + distinct + 1))
                known, base, model = (np.add.reduceat(x, starts) for x in ((words > 0).astype(np.int64), base, model))
                cols = [ids.values, held, lengths, known, np.full(len(lengths), n), base, model]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(cols, SCORED.values(), strict=True)], [id_col, *[*SCORED][1:]])

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_batches(counts.drop("cells", "cell_n"), scored, schema)
