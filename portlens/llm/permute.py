"""Keyed pseudorandom permutations of 0..n-1: a Feistel network with cycle walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def _network(x: np.ndarray, half: np.uint64, keys: list[np.ndarray]) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for key in keys:
        left, right = right, left ^ (_mixed((right + key) * _ODD) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, size: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """Where the permutation of 0..size-1 under the key takes each index.

    The network works on the next even power of two; a value beyond the size is
    put through it again until it lies within (under four times on average).
    """
    x = np.asarray(index, dtype=np.uint64)
    size = np.broadcast_to(np.asarray(size, dtype=np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, dtype=np.uint64), x.shape)
    out = x.copy()
    bits = np.frompyfunc(lambda n: max(1, (int(n - 1).bit_length() + 1) // 2), 1, 1)
    sizes, where = np.unique(size, return_inverse=True)
    halves = bits(sizes.astype(object)).astype(np.uint64)[where.ravel()] if len(sizes) else np.zeros(0, np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            keys = [_mixed(key[todo] * _ODD + np.uint64(turn + 1)) for turn in range(ROUNDS)]
            out[todo] = _network(out[todo], halves[todo], keys)
            todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)
