"""Passage removal against a plain one that keeps all windows of all documents in a dictionary."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from evidentia.llm import passages


def plain(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [-(2**63) if i is None else i for i, _ in rows]
    first = {}
    for who, ws in zip(ids, words, strict=True):
        for at in range(len(ws) - width + 1):
            key = tuple(ws[at : at + width])
            first[key] = min(first.get(key, who), who)
    out = []
    for (doc, _), who, ws in zip(rows, ids, words, strict=True):
        gone = set()
        for at in range(len(ws) - width + 1):
            if first[tuple(ws[at : at + width])] < who:
                gone.update(range(at, at + width))
        out.append((doc, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def mosaic(draw, n, pieces, letters):
    """Texts put together from shared pieces, edits and few different words, so that windows meet at all distances."""
    shared = [[draw.choice(letters) for _ in range(draw.randint(1, 40))] for _ in range(pieces)]
    texts = []
    for _ in range(n):
        ws = []
        for _ in range(draw.randint(0, 6)):
            piece = list(draw.choice(shared))
            if draw.random() < 0.3 and piece:
                piece[draw.randrange(len(piece))] = draw.choice(letters)
            ws += piece[draw.randint(0, 5) :]
        texts.append(draw.choice([" ", "\n", " \t"]).join(ws))
    return texts


@pytest.mark.parametrize(("width", "gram", "letters", "seed"), [(8, 3, "abcdefgh", 1), (8, 8, "abc", 2), (5, 1, "ab", 3), (12, 5, [*"abcdefghijklmnopqrstuvwxyz"], 4)])
def test_rows_are_the_plain_ones(spark, width, gram, letters, seed):
    draw = random.Random(seed)
    texts = mosaic(draw, 120, 9, [*letters])
    rows = [(draw.choice([i, i, i, 7, None]), t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \n"), (503, "a " * 3_000), (504, "a " * 3_000), (505, "é ü　x \xa0y " * 9), (506, "é ü　x \xa0y " * 9)]
    rows += rows[:4]
    docs = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, text string, who int, t string").repartition(3)
    got = passages.passage_digest(passages.drop_passages(docs, width=width, gram=gram)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, width)


def test_factors_point_at_equal_words(spark):
    draw = random.Random(11)
    texts = mosaic(draw, 80, 5, [*"abcdefghijkl"])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    seen = 0
    for r in passages.drop_passages(rows, width=10, gram=4).collect():
        for f in r["factors"]:
            assert f["source"] < r["doc_id"] and f["end"] - f["start"] >= 10
            assert words[r["doc_id"]][f["start"] : f["end"]] == words[f["source"]][f["place"] : f["place"] + f["end"] - f["start"]]
            seen += 1
    assert seen


def test_gram_hashes_are_polynomials():
    h = np.arange(1, 60, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3, 20, 50, 59):
            want = [sum(int(h[i + k]) * pow(int(passages.BASES[0]), k, 2**64) for k in range(n)) % 2**64 for i in range(len(h) - n + 1)]
            assert passages.gram_hashes(h, n, passages.BASES[0]).tolist() == want
        assert len(passages.gram_hashes(h, 61, passages.BASES[0])) == 0


def test_no_rows(spark):
    assert passages.drop_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
