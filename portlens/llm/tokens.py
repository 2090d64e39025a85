"""Token ids of texts by a tokenizer that drops white space, one word at a time.

The tokenizer never joins what ASCII white space separates, so the ids of a text are
those of its words, and a word met before is looked up. A new word of plain Latin
letters, digits and signs is cut into its parts here and only parts that are new go to
the tokenizer, many in one text, spelled in the signs of its byte-level vocabulary and
with a line end after each; any other word goes there whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, groupby, pairwise

import numpy as np
import regex

END_ID = 2
REMEMBERED_WORDS = 500_000
# The tokenizer's own pattern of parts (and a line end between words), its marker of special tokens.
PART = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIAL = "<|"
# Here lower case is a matter of single characters and composed form changes nothing.
PLAIN = regex.compile("[!-~\u00a1-\u024f\n]+")
JOINED = 64


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key: bytes | str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def take_new(self) -> list:
        new, self.new = self.new, []
        return new


class _Ragged:
    """Rows of ids of any length in one array that grows."""

    def __init__(self) -> None:
        self.values = np.zeros(1 << 16, dtype="<u4")
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.n = 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        start, stop = self.n + 1, self.n + 1 + len(lengths)
        while stop > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        before = self.ends[self.n]
        while before + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[before : before + len(values)] = values
        self.ends[start:stop] = before + np.cumsum(lengths)
        self.n += len(lengths)

    def extend_lists(self, rows: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.extend(np.fromiter(chain.from_iterable(rows), "<u4", int(lengths.sum())), lengths)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the index one after another, and their lengths."""
        starts, lengths = self.ends[index], self.ends[index + 1] - self.ends[index]
        shift = starts - (np.cumsum(lengths) - lengths)
        return self.values[np.repeat(shift, lengths) + np.arange(lengths.sum())], lengths


class WordTokens:
    """Encodes texts as little-endian unsigned 32-bit ids. The tables of words and of parts are emptied when full, each by itself."""

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        signs = {byte: sign for sign, byte in byte_signs().items()}
        at_ends = {"type": "Split", "pattern": {"String": signs[10]}, "behavior": "Isolated", "invert": False}
        self.of_parts = Tokenizer.from_str(json.dumps(layout | {"normalizer": None, "pre_tokenizer": at_ends, "added_tokens": []}))
        self.spelled = str.maketrans({chr(byte): sign for byte, sign in signs.items()})
        (self.line_end,) = self.of_parts.encode(signs[10], add_special_tokens=False).ids
        self.remembered = remembered
        self._empty_words()
        self._empty_parts()

    def _empty_words(self) -> None:
        self.words, self.word_ids = Numbers(), _Ragged()

    def _empty_parts(self) -> None:
        self.parts, self.part_ids = Numbers(), _Ragged()
        self.parts["\n"] = 0
        self.part_ids.extend_lists([[]])

    def _learn(self) -> None:
        """Ids of the new words. Odd words and stretches of plain ones take turns."""
        new = b"\n".join(self.words.take_new()).decode()
        if PLAIN.fullmatch(new) and SPECIAL not in new:
            self._learn_plain(new)
            return
        for plain, stretch in groupby(new.split("\n"), lambda word: PLAIN.fullmatch(word) is not None and SPECIAL not in word):
            if plain:
                self._learn_plain("\n".join(stretch))
            else:
                self.word_ids.extend_lists([e.ids for e in self.whole.encode_batch_fast(list(stretch), add_special_tokens=False)])

    def _learn_parts(self) -> None:
        new = self.parts.take_new()
        joined = ["\n".join(new[at : at + JOINED]) + "\n" for at in range(0, len(new), JOINED)]
        spelled = [lines.encode().decode("latin-1").translate(self.spelled) for lines in joined]
        encoded = [np.array(e.ids, "<u4") for e in self.of_parts.encode_batch_fast(spelled, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *encoded])
        end = ids == self.line_end
        self.part_ids.extend(ids[~end], np.diff(np.flatnonzero(end), prepend=-1) - 1)

    def _learn_plain(self, lines: str) -> None:
        index = self.parts.of(PART.findall(lines.lower()))
        self._learn_parts()
        values, lengths = self.part_ids.take(index)
        ends = np.append(np.flatnonzero(index == 0), len(index))
        self.word_ids.extend(values, np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends], prepend=0))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.remembered:
            self._empty_words()
        if len(self.parts) > self.remembered:
            self._empty_parts()
        found = [self.words.of(text.encode().split() if text else []) for text in texts]
        if self.words.new:
            self._learn()
        values, lengths = self.word_ids.take(np.concatenate([np.zeros(0, np.int64), *found]))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, found)])]
        return [values[a:b] for a, b in pairwise(ends)]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
