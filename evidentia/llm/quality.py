"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_batches, per_worker, text_runs

F32 = np.float32


@dataclass
class Network:
    """Bytes -> vectors -> filters over windows -> mean in each chunk -> layer -> maximum over chunks -> probability.

    A window is `width` bytes and moves by `stride`; a chunk is `chunk` windows and moves by half of that. Both overlap,
    and the last ones are padded with zero bytes, so that every byte of a text of any length is seen.
    """

    width: int = 24
    stride: int = 4
    chunk: int = 16
    dims: int = 6
    filters: int = 48
    hidden: int = 32
    seed: int = 5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            table = rng.normal(0, 0.5, (256, self.dims))
            table[0] = 0  # padding
            self.weights = {
                "table": table,
                "w1": rng.normal(0, (2 / (self.width * self.dims)) ** 0.5, (self.width * self.dims, self.filters)),
                "b1": np.zeros(self.filters),
                "w2": rng.normal(0, (2 / self.filters) ** 0.5, (self.filters, self.hidden)),
                "b2": np.zeros(self.hidden),
                "w3": rng.normal(0, (1 / self.hidden) ** 0.5, self.hidden),
                "b3": np.zeros(1),
            }
            self.weights = {k: v.astype(F32) for k, v in self.weights.items()}

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes padded, half-chunks of each text, where each text's half-chunks begin).

        Texts are laid out in whole half-chunks, two at least, each with enough empty ones behind it that no window
        reaches from one text into the next.
        """
        half = self.stride * self.chunk // 2
        gap = -(-(self.width - self.stride) // half)
        sizes = np.array([max(2, -(-len(t) // half)) for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes + gap)))
        data = np.zeros(starts[-1] * half + self.width, np.uint8)
        for t, s in zip(texts, starts, strict=False):
            data[s * half : s * half + len(t)] = np.frombuffer(t, np.uint8)
        return data, sizes, starts[:-1]

    def forward(self, texts: list[bytes], keep: bool = False) -> tuple:
        p = self.weights
        data, sizes, starts = self.layout(texts)
        vectors = p["table"][data]
        step = self.stride * self.dims
        n = (len(data) - self.width) // self.stride
        windows = np.lib.stride_tricks.as_strided(vectors, (n, self.width * self.dims), (step * 4, 4))
        act = windows @ p["w1"]
        act += p["b1"]
        np.maximum(act, 0, out=act)
        halves = act.reshape(-1, self.chunk // 2, self.filters).mean(1)
        # a chunk is two neighbouring half-chunks of one text
        first = np.cumsum(sizes - 1) - (sizes - 1)
        left = np.repeat(starts - first, sizes - 1) + np.arange((sizes - 1).sum())
        means = (halves[left] + halves[left + 1]) / 2
        layer = means @ p["w2"] + p["b2"]
        np.maximum(layer, 0, out=layer)
        top = np.maximum.reduceat(layer, first, axis=0)
        logit = top @ p["w3"] + p["b3"][0]
        return (logit, top, layer, first, left, means, act, windows, data) if keep else (logit,)

    def score(self, texts: list[bytes], slab: int = 1 << 16) -> np.ndarray:
        """Probability of label 1 for each text; a long text is a row of chunks whose maxima are combined, so memory is bounded."""
        out = np.empty(len(texts))
        half = self.stride * self.chunk // 2
        group, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > slab:
                out[i] = self._long(t, slab // half)
                continue
            group.append(i)
            size += len(t) + half
            if size >= slab:
                out[group] = self.forward([texts[k] for k in group])[0]
                group, size = [], 0
        if group:
            out[group] = self.forward([texts[k] for k in group])[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _long(self, text: bytes, chunks: int) -> float:
        """The logit of one long text, `chunks` chunks at a time: each slab has the bytes that its last window reads, and
        of its chunks those count that a pass over the whole text has."""
        half = self.stride * self.chunk // 2
        every = -(-len(text) // half) - 1
        tops = []
        for at in range(0, every, chunks):
            slab = text[at * half : (at + chunks + 1) * half + self.width]
            tops.append(self.forward([slab], keep=True)[2][: min(chunks, every - at)].max(0))
        return float(np.max(tops, axis=0) @ self.weights["w3"] + self.weights["b3"][0])

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.weights
        logit, top, layer, first, left, means, act, windows, data = self.forward(texts, keep=True)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-(weight * np.where(labels, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).mean())
        d_logit = (weight * (prob - labels) / len(texts)).astype(F32)
        grads = {"w3": top.T @ d_logit, "b3": np.array([d_logit.sum()], F32)}
        d_top = d_logit[:, None] * p["w3"]
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(layer))))
        is_top = (layer == top[owner]) & (layer > 0)
        # one place only takes the gradient: the first that reaches the maximum
        order = np.cumsum(is_top, axis=0)
        base = np.where(first[:, None] > 0, order[first - 1], 0)
        d_layer = np.where(is_top & (order - base[owner] == 1), d_top[owner], 0).astype(F32)
        grads["w2"], grads["b2"] = means.T @ d_layer, d_layer.sum(0)
        d_means = d_layer @ p["w2"].T
        d_halves = np.zeros((len(act) // (self.chunk // 2), self.filters), F32)
        np.add.at(d_halves, left, d_means / 2)
        np.add.at(d_halves, left + 1, d_means / 2)
        live = np.flatnonzero(np.abs(d_halves).sum(1))
        rows = (live[:, None] * (self.chunk // 2) + np.arange(self.chunk // 2)).reshape(-1)
        d_act = np.repeat(d_halves[live] / (self.chunk // 2), self.chunk // 2, axis=0) * (act[rows] > 0)
        seen = windows[rows]
        grads["w1"], grads["b1"] = seen.T @ d_act, d_act.sum(0)
        d_seen = (d_act @ p["w1"].T).reshape(-1, self.dims)
        at = (rows[:, None] * self.stride + np.arange(self.width)).reshape(-1)
        table = np.zeros_like(p["table"])
        for d in range(self.dims):
            table[:, d] = np.bincount(data[at], weights=d_seen[:, d], minlength=256)
        table[0] = 0
        grads["table"] = table
        return loss, grads

    def fit(self, texts: list[bytes], labels: np.ndarray, *, epochs: int = 16, batch: int = 32, rate: float = 0.01, steps: int = 1_000) -> Network:
        """Adam on class-balanced cross entropy; the seed fixes weights and order, so reruns agree. Small samples are gone
        through more often, up to four times, to make `steps` steps."""
        rng = np.random.default_rng(self.seed)
        epochs = min(4 * epochs, max(epochs, -(-steps * batch // max(1, len(texts)))))
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) if 0 < share < 1 else np.ones(len(labels))
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for s in range(0, len(order), batch):
                part = order[s : s + batch]
                _, grads = self.gradients([texts[i] for i in part], labels[part].astype(F32), weight[part])
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.weights[k] = (self.weights[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(F32)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int, folds: int, held_fold: int) -> DataFrame:
    """(text, label): a bounded sample of labelled rows outside the held-out fold, the `most` first by a hash of id and label.

    The sample is drawn from the labels alone; its at most `most` ids are broadcast, so texts are filtered where they
    lie and only the sample's leave the executors. An id with both labels gives a row for each, an id with several
    texts one for each text; labels or ids that are null are left out.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label is not null and id is not null").distinct()
    drawn = marks.filter(fold_of(F.col("id"), folds) != held_fold).orderBy(F.xxhash64("id", "label"), "id", "label").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    found = texts.join(F.broadcast(drawn), "id").select("id", "text", "label")
    # ids may have several rows: which of them are in the sample depends on nothing but the rows
    return found.orderBy(F.xxhash64("id", "label"), F.xxhash64("text"), "id", "label").limit(most)


def slices(good: list[bytes], most: int, seed: int) -> list[bytes]:
    """Short pieces of good texts, which are good too: without them short texts, rare among labelled rows, score low."""
    rng = np.random.default_rng(seed)
    out = []
    for i in rng.permutation(len(good))[:most]:
        words = good[i].split(b" ")
        at, n = int(rng.integers(0, len(words))), int(rng.integers(1, 25))
        out.append(b" ".join(words[at : at + n]))
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 3_000,
    sample_text_bytes: int = 20_000,
    sample_slices: int = 600,
    folds: int = 4,
    held_fold: int = 2,
) -> Network:
    """Fit the network on at most sample_rows labelled rows whose texts have at most sample_text_bytes bytes, and on at
    most sample_slices short pieces of those labelled good.

    The bounds hold for learning only; scoring sees whole texts of any length. Rows whose crc32 of the id modulo
    `folds` is held_fold are never learned from. Without labels the untrained network gives about 0.5 everywhere.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample_rows, sample_text_bytes, folds, held_fold).collect()
    net = Network()
    if not rows:
        return net
    rows.sort(key=lambda r: (r["id"], r["label"], r["text"]))  # tasks end in any order
    texts, marks = [r["text"].encode() for r in rows], [int(r["label"] == 1) for r in rows]
    short = slices([t for t, m in zip(texts, marks, strict=True) if m], min(sample_slices, len(texts) // 5), net.seed)
    return net.fit(texts + short, np.array(marks + [1] * len(short)))


def classify(
    docs: DataFrame,
    net: Network,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    accept: float = 0.7,
    folds: int = 4,
    held_fold: int = 2,
    keep: bool = False,
) -> DataFrame:
    """(id, held_out, score, predicted) for each row, or with `keep` the input's columns and __score, __predicted.

    The score depends on the text alone, not on what shares its batch. Null and empty texts get the network's score of
    padding. Ids may be null (not held out) or repeat; each row is scored by itself. An empty table gives no rows. One
    narrow stage; a text of any length is scored whole, a bounded number of chunks at a time.
    """
    names = docs.columns if keep else [id_col]
    mark = "__" if keep else ""
    key = ("network", zlib.crc32(b"".join(w.tobytes() for w in net.weights.values())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = per_worker(key, lambda: net)
        for batch in batches:
            score = np.concatenate([network.score([t.encode() for t in texts]) for _, _, texts in text_runs(batch.column(0))] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= accept).astype(np.int32))], [*names, f"{mark}score", f"{mark}predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    source = docs.select(F.col(text_col).alias("__body"), *[F.col(f"`{c}`") for c in names])
    scored = map_batches(source, task, f"{schema}, {mark}score double, {mark}predicted int")
    if keep:
        return scored
    return scored.select(id_col, (fold_of(F.col(id_col), folds) == held_fold).alias("held_out"), "score", "predicted")
