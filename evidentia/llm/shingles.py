"""Word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied by `words_of` when it holds many words, which changes no result."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased: bytes.split() and bytes.lower() know ASCII only."""
    return text.encode().lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every bit depends on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_sets(texts: list[str], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Each text's set of `width`-word shingles as sorted distinct hashes.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    if len(hashes) > hashes.most:
        hashes.clear()
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            words = words_of(text)
            if not words:
                out.append(np.empty(0, U64))
                continue
            h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
            n = min(width, len(words))
            acc = np.full(len(words) - n + 1, U64(n), U64)
            for k in range(n):
                acc = mixed(acc * U64(0x9E3779B97F4A7C15) + h[k : k + len(acc)])
            acc.sort()
            out.append(acc[np.concatenate(([True], acc[1:] != acc[:-1]))])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, exactly."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return 100 * common >= percent * (len(a) + len(b) - common)
