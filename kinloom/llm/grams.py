"""Hashed character n-grams of words, for many words at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import join_words, mix64


def hashed(words: list[bytes], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's number) for each n-gram of each word between two end marks, and for each word as a whole. buckets: a power of two."""
    lengths, data = join_words([b"\x02" + w + b"\x03" for w in words])
    data, owner = data.astype(np.uint64), np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    at, of = [], []
    mask = np.uint64(buckets - 1)
    for n in sizes:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | data[j : len(data) - n + 1 + j]
        inside = owner[: len(code)] == owner[n - 1 :]
        at.append((mix64(code[inside]) & mask).astype(np.int64))
        of.append(owner[: len(code)][inside])
    if whole:
        at.append((np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & mask).astype(np.int64))
        of.append(np.arange(len(words), dtype=np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(of or none)


def means(words: list[bytes], values: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Mean of the values of each word's buckets."""
    at, of = hashed(words, sizes, len(values))
    n = np.bincount(of, minlength=len(words))
    return np.bincount(of, values[at], len(words)) / np.maximum(n, 1)
