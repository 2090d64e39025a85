"""Hashes of words and of five-word shingles, many texts at a time."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from portlens.llm.common import byte_words

WIDTH = 5
# One odd factor for each word of a shingle; fewer words take the first ones and a factor for their number.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SHORT = np.uint64(0xE7037ED1A0B428DB)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of all texts, repeats included, and the number of the text each is from.

    Words are lower-cased (A-Z). A text of one to four words has one shingle, its
    whole sequence; a text without words has none.
    """
    found = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) for words in map(byte_words, texts)]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    words = np.concatenate([np.zeros(0, np.uint64), *found])
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WIDTH + 1)
        sums = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            sums += words[k : k + n] * _FACTORS[k]
        owner = np.repeat(np.arange(len(found)), counts)
        whole = owner[:n] == owner[WIDTH - 1 : WIDTH - 1 + n]
        short = np.flatnonzero((counts > 0) & (counts < WIDTH))
        extra = np.array([int((found[t] * _FACTORS[: counts[t]]).sum(dtype=np.uint64) + _SHORT * np.uint64(counts[t])) & (2**64 - 1) for t in short], dtype=np.uint64)
    return mixed(np.concatenate([sums[whole], extra])), np.concatenate([owner[:n][whole], short])
