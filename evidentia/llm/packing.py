"""Best-fit packing of documents into token sequences by bin completion branch-and-bound."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, count, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, per_worker, text_runs, written

#: A character that is one token, which comes from no other character.
MARK = "~"

#: First bytes of characters from U+0180 on. Letters before have no compositions and, but for U+0130, lower forms of one letter.
HIGH = bytes(range(0xC6, 0x100))

#: How the byte-level alphabet spells bytes that are not printable: as the letters from U+0100 on, in order.
SPELLING = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

# Fixed value: the pre-tokens of the word-level vocabulary, for which the rules of this module hold.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def simpler(text: str) -> str:
    """A text with the same ids and fewer different chunks: in lower case, as the normalizer makes it, where that is
    sure to change nothing; other texts as they are."""
    if "<" in text or "\u0130" in text:
        return text
    if not text.isascii():
        data = text.encode()
        if len(data.translate(None, HIGH)) < len(data):
            return text
    return text.lower()


#: Lower-case letters below U+0100: neither the normalizer nor the pre-tokenizer changes or cuts words of them.
plain_word = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


class ChunkEncoder:
    """Token ids of whole texts, from ids of their blank-free chunks.

    The pre-tokenizer of the word-level vocabulary matches nothing across ASCII blanks and drops them, its
    normalizer composes nothing with them, and no special string holds one. A text's ids are therefore its chunks'
    ids one after another, and a chunk that was seen before need not be encoded again. Whether a file is of that kind
    is read from it; with any other, whole texts are encoded. Chunks of a run of texts are told apart by Arrow, so that
    Python sees each distinct one once. When the cache holds half of `most_bytes` it becomes the older half, of which
    chunks that come up again are taken over; this bounds the memory and changes no result.
    """

    def __init__(self, tokenizer_path: str, most_bytes: int = 80 << 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunked = self.of_word_level(json.loads(self.tokenizer.to_str()))
        self.most, self.held, self.known, self.before = most_bytes, 0, {"": b""}, {}
        if not self.chunked:
            return
        # for lower-case Latin words the normalizer changes nothing and the pattern takes the whole word
        self.words = Tokenizer.from_file(tokenizer_path)
        self.words.normalizer = self.words.pre_tokenizer = None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True  # a word's last token
        self.mark = np.frombuffer(self.whole(MARK), "<u4")
        self.stops = {x: self.whole(x) for x in ".,"}

    @staticmethod
    def of_word_level(spec: dict) -> bool:
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = before[0].get("pattern", {}).get("Regex") if before else None
        plain = all(not (t["lstrip"] or t["rstrip"]) and t["content"][:1] == "<" and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
        return kinds == ["NFC", "Replace", "Lowercase"] and pattern == WORD_PATTERN and [x["type"] for x in before[1:]] == ["ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>" and plain

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = pc.ascii_split_whitespace(pa.array([simpler(x) for x in texts], pa.string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(filterfalse(self.known.__contains__, chunks)))
        found = [self.known[x] for x in chunks]
        if 2 * self.held > self.most:
            self.before, self.known, self.held = self.known, {"": b""}, 0
        # the ids of the distinct chunks one after another, gathered in the order of the texts
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, index = np.cumsum(size) - size, coded.indices.to_numpy()
        count = size[index]
        end = np.concatenate(([0], np.cumsum(count)))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start[index] - end[:-1], count) + np.arange(end[-1])]
        edges = end[split.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)]

    def learn(self, new: set[str]) -> None:
        """Ids of chunks that are not known yet; a stop after a plain word is a pre-token by itself."""
        again = new & self.before.keys()
        self.known.update((x, self.before[x]) for x in again)
        new -= again
        stopped = [x for x in new if x[-1] in ".," and plain_word(x[:-1])]
        new.difference_update(stopped)
        new.update(filterfalse(self.known.__contains__, (x[:-1] for x in stopped)))
        words = {x for x in new if plain_word(x)}
        marked = [x for x in new if MARK in x]
        self.learn_words(list(words))
        self.learn_others(list(new - words.union(marked)))
        self.known.update((x, self.whole(x)) for x in marked)
        self.known.update((x, self.known[x[:-1]] + self.stops[x[-1]]) for x in stopped)
        self.held += 180 * (len(again) + len(new) + len(stopped))

    def learn_words(self, new: list[str], at_once: int = 2_000) -> None:
        """Encode unseen plain words many at a time, given as the byte-level alphabet spells them."""
        for first in range(0, len(new), at_once):
            part = new[first : first + at_once]
            spelled = [x if x.isascii() else x.encode().decode("latin-1").translate(SPELLING) for x in part]
            (found,) = self.words.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            self.keep(part, ids.tobytes(), [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()], 0)

    def learn_others(self, new: list[str], at_once: int = 2_000) -> None:
        """Encode unseen chunks many at a time, with a mark between them that none of them holds."""
        n = len(self.mark)
        for first in range(0, len(new), at_once):
            part = new[first : first + at_once]
            (found,) = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*part, ""])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            here = ids[: len(ids) - n + 1] == self.mark[0]
            for k in range(1, n):
                here &= ids[k : len(ids) - n + 1 + k] == self.mark[k]
            self.keep(part, ids.tobytes(), [0, *(np.flatnonzero(here) + n).tolist()], n)

    def keep(self, chunks: list[str], data: bytes, edges: list[int], less: int) -> None:
        for chunk, x, y in zip(chunks, edges, edges[1:], strict=False):
            self.known[chunk] = data[4 * x : 4 * (y - less)]


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, spread (a number to deal pieces out by), ids if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = per_worker(("chunks", tokenizer_path), lambda: ChunkEncoder(tokenizer_path)), 0
        for batch in batches:
            for first, _, texts in text_runs(batch.column(1), 3 << 20):
                rows, cols = [], [[], [], [], [], [], []]
                for row, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(row)
                        seen += 1
                        for col, value in zip(cols, (piece, at // 4, len(part) // 4, zlib.crc32(part), zlib.crc32(b"%d %d" % (seen, zlib.crc32(part))), part), strict=True):
                            col.append(value)
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(x, pa.int64()) for x in cols[1:5])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[5], pa.binary())] * with_ids, [id_col, "piece", "start", "length", "ids_crc32", "spread", *["ids"] * with_ids])

    return map_batches(docs.select(id_col, text_col), task, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, spread long" + ", ids binary" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions; each size, given in falling order, goes where least room stays."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i, size in enumerate(sizes):
        fitting = open_rooms >> size
        left = size + (fitting & -fitting).bit_length() - 1 if fitting else capacity
        if fitting:
            k = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
            bins[k].append(i)
        else:
            k = len(bins)
            bins.append([i])
        room[left - size].append(k)
        open_rooms |= 1 << (left - size)
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that no packing can do without: Martello and Toth's L2, and rounded sizes that sum to one bin at most.

    L2 takes, for each k, sizes above capacity - k as alone in their bins, sizes above half as one a bin, and asks what
    sizes from k to half need beyond the room beside those. The rounded sizes floor((m + 1) * size / capacity) / m
    of what fits one bin sum to 1 at most (a multiple of capacity / (m + 1) counts as it is), for any m.
    """
    x = np.sort(np.asarray(sizes, np.int64))
    if not len(x):
        return 0
    sums = np.concatenate(([0], np.cumsum(x)))
    best = -(-int(sums[-1]) // capacity)
    half = int(np.searchsorted(x, capacity // 2, "right"))
    for k in np.unique(np.append(x[:half], 0)).tolist():
        alone, low = int(np.searchsorted(x, capacity - k, "right")), int(np.searchsorted(x, k, "left"))
        room = (alone - half) * capacity - int(sums[alone] - sums[half])
        over = int(sums[half] - sums[min(low, half)]) - room
        best = max(best, len(x) - half + max(0, -(-over // capacity)))
    for m in range(1, 25):
        scaled = (m + 1) * x
        exact = scaled % capacity == 0
        # everything times m * capacity, in whole numbers
        total = int(np.where(exact, m * x, scaled // capacity * capacity).sum())
        best = max(best, -(-total // (m * capacity)))
    return best


def fillings(values: list[int], counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of `room` from the sizes at hand (values fall), drawn one by one, best filled first;
    None stands for a dominated one, so that who draws can count them.

    A size that fills the room by itself dominates all others. Then comes the pair of the largest first that fills it,
    if there is one. Beyond, sums that the sizes from each place on can reach are bits of an integer, so that every step
    of the enumeration ends in a filling.
    """
    if counts.get(room):
        yield (room,)
        return
    pair = None
    for v in values[bisect_left(values, -room, key=lambda v: -v) : bisect_left(values, -room // 2 + 1, key=lambda v: -v)]:
        rest = room - v
        if counts[v] and counts.get(rest) and (rest < v or counts[v] > 1):
            pair = (v, rest)
            yield pair
            break
    usable = [v for v in values[bisect_left(values, -room, key=lambda v: -v) :] if counts[v]]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(usable) + 1)
    for i in range(len(usable) - 1, -1, -1):
        sums, left, step, v = reach[i + 1], counts[usable[i]], 1, usable[i]
        while left > 0:
            sums |= sums << (min(step, left) * v) & mask
            left, step = left - step, 2 * step
        reach[i] = sums

    def exactly(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while i < len(usable) and reach[i] >> total & 1:
            v = usable[i]
            for k in range(min(counts[v], total // v), 0, -1):
                if reach[i + 1] >> (total - k * v) & 1:
                    for rest in exactly(i + 1, total - k * v):
                        yield (v,) * k + rest
            i += 1

    rising = usable[::-1]
    total = reach[0].bit_length() - 1
    while total >= 0:
        if reach[0] >> total & 1:
            for chosen in exactly(0, total):
                if chosen != pair:
                    yield None if dominated(chosen, rising, counts, room - total) else chosen
        total -= 1


def dominated(chosen: tuple[int, ...], rising: list[int], counts: dict[int, int], slack: int) -> bool:
    """Whether an unused size can take the place of some pieces (none, one or more) of a filling, with no less fill."""
    used = Counter(chosen)
    most = len(used) if len(chosen) <= 8 else 2
    for n in range(min(most, len(chosen)) + 1):
        for part in set(combinations(chosen, n)):
            t = sum(part)
            at = bisect_left(rising, t + (n < 2))
            while at < len(rising) and rising[at] <= t + slack:
                if counts[rising[at]] > used.get(rising[at], 0):
                    return True
                at += 1
    return False


def complete_bins(sizes: list[int], capacity: int, fewest: int, bound: int, node_limit: int) -> list[tuple[int, ...]] | None:
    """Bins of fewer than `fewest` by bin completion, or None where the search finds none.

    The largest piece left opens a bin, and its undominated fillings are tried best filled first. A branch ends when
    its waste so far leaves less than a bin fewer than the best can have; later fillings waste more, so the whole level
    ends. Branches are taken in order of how often they leave the best filling (0 times, once, twice, ...): early bins
    are varied as soon as late ones. The search ends at the bound, with the tree, or after node_limit fillings drawn.
    """
    counts = Counter(sizes)
    values = sorted(counts, reverse=True)
    total, shape, nodes, spent = sum(sizes), None, 0, (-1,)
    for leaves in count():
        cut, left, path = False, len(sizes), []

        def opened(waste: int, at: int, may: int) -> list:
            while not counts[values[at]]:
                at += 1
            counts[values[at]] -= 1
            return [values[at], fillings(values[at:], counts, capacity - values[at]), waste, (), at, may]

        path.append(opened(0, 0, leaves))
        left -= 1
        while path and nodes < node_limit and fewest > bound:
            level = path[-1]
            top, ways, waste, taken, at, may = level
            for v in taken:
                counts[v] += 1
            left, level[3] = left + len(taken), ()
            chosen = next(ways, spent) if may >= 0 else spent
            nodes += 1
            if chosen is None:
                continue
            cut = cut or may < 0
            level[5] = may - 1
            wasted = waste + capacity - top - sum(chosen)
            if chosen is spent or wasted > (fewest - 1) * capacity - total:
                counts[top] += 1
                left += 1
                path.pop()
                continue
            for v in chosen:
                counts[v] -= 1
            left, level[3] = left - len(chosen), chosen
            if left:
                path.append(opened(wasted, at, may))
                left -= 1
            elif len(path) < fewest:
                fewest, shape = len(path), [(x[0], *x[3]) for x in path]
        for top, _, _, taken, *_ in path:
            counts.update([top, *taken])
        if not cut or nodes >= node_limit or fewest <= bound:
            return shape
    return shape


def pack_block(sizes: list[int], capacity: int, *, node_limit: int = 20_000) -> list[list[int]]:
    """Bins of positions of `sizes`, as few as the search finds.

    Best-fit decreasing gives the first incumbent; where it misses the lower bound, bin completion looks for fewer.
    node_limit bounds the effort, never the pieces: when it is spent, the incumbent stands.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    incumbent = best_fit([sizes[i] for i in order], capacity)
    bound = lower_bound(sizes, capacity)
    shape = complete_bins(sizes, capacity, len(incumbent), bound, node_limit) if len(incumbent) > bound else None
    if shape is None:
        return [[order[i] for i in b] for b in incumbent]
    places: dict[int, list[int]] = {}
    for i in order:
        places.setdefault(sizes[i], []).append(i)
    return [[places[v].pop() for v in b] for b in shape]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    block_pieces: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every row's token ids (then end_id) into sequences of at most `capacity` tokens.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset), with `ids` (little-endian unsigned 32-bit) if
    asked for. Only a document longer than a sequence is cut. Full pieces are sequences already; the others are dealt
    into blocks of about block_pieces by a hash, and each block is packed in its own task, so a block's unfilled rest
    (about one sequence) is all that dealing costs. Null and empty texts are one piece with only the end id. Repeated
    rows and null ids are packed row by row. An empty table gives no rows. Other columns are not read.
    """
    pieces = written(cut_documents(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    partial = pieces.filter(F.col("length") < capacity)
    blocks = max(1, round(partial.count() / block_pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]

    def one_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "spread"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes = block["length"].tolist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, members in enumerate(pack_block(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        block["sequence_id"], block["offset"] = (np.int64(key[0]) << 32) + sequence, offset
        return block[names]

    packed = partial.withColumn("block", F.pmod(F.col("spread"), F.lit(blocks))).groupBy("block").applyInPandas(one_block, out)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.select(*names).unionByName(packed)
