"""Two tokenizers' ids of texts, aligned by the byte offsets where tokens of both end.

A text is cut into units that neither tokenizer's tokens cross: at every single space or
line end between two other characters. A unit met before is looked up; the ids, groups and
linked pairs of new ones are worked out together. A text with any other white space is one
unit, as is every text if the piece vocabulary has a piece that could cross a cut.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from portlens.llm.tokens import Numbers, _Ragged, byte_signs

REMEMBERED_BYTES = 4 << 20
_ODD = re.compile(r"\s\s|[^\S \n]|\s\Z")
SPACE_SIGN = "▁"


class Aligner:
    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        signs = byte_signs()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(signs[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search(rf"[^{SPACE_SIGN}]{SPACE_SIGN}|\n| ", p) for p in pieces)
        self.space = pieces.index(SPACE_SIGN)
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        if len(self.bytes_a) > 1 << 16 or len(pieces) > 1 << 15:
            raise ValueError("pairs hold ids of 16 and 15 bits")
        # The last id of a side is followed by the sign that ends it.
        self.spelled = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(pieces), ",;\n")) for end in ends for i in range(n)]
        self.remembered = remembered
        self._empty()

    def _empty(self) -> None:
        self.units, self.size = Numbers(), 0
        self.pairs, self.times = _Ragged(), _Ragged()
        self.counts = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.texts: list[str] = []

    def units_of(self, text: str) -> list[str]:
        """A unit without its space in front, a unit that begins a line, or a whole text with a space in front."""
        spaced = " " + text
        if not self.cuts or _ODD.search(spaced):
            return [spaced]
        return text.replace("\n", " \n").split(" ")

    def _encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bytes]]:
        full = [u if u[0] in " \n" else " " + u for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, unit in enumerate(units):
            # The space that is always put in front stands alone before a line end.
            if unit[0] == "\n":
                b[k] = b[k][1:] if b[k][0] == self.space else []
        return a, b, [u.encode() for u in full]

    def _learn(self) -> None:
        units = self.units.take_new()
        self.size += sum(map(len, units))
        a, b, source = self._encoded(units)
        good = np.ones(len(units), bool)
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            lengths = [sum(map(len, map(table.__getitem__, x))) for x in ids]
            if lengths != list(map(len, source)) or b"".join(map(table.__getitem__, chain.from_iterable(ids))) != b"".join(source):
                good &= [b"".join(map(table.__getitem__, x)) == s for x, s in zip(ids, source, strict=True)]
        if not good.all():
            a = [x if g else [] for x, g in zip(a, good, strict=True)]
            b = [x if g else [] for x, g in zip(b, good, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a = np.fromiter(chain.from_iterable(a), np.int64, int(n_a.sum()))
        flat_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        unit_of_group = np.zeros(len(common), np.int64)
        unit_of_group[group_a] = np.repeat(np.arange(len(units)), n_a)
        n_groups = np.bincount(unit_of_group, minlength=len(units))
        links = np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common))
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, unit_of_group, links)

        # In a group every id of A is linked with every id of B; each is taken once, with its number.
        side_a, many_a = np.unique(group_a << 32 | flat_a, return_counts=True)
        side_b, many_b = np.unique(group_b << 32 | flat_b, return_counts=True)
        of_a, of_b = side_a >> 32, side_b >> 32
        sizes = np.bincount(of_b, minlength=len(common))
        first = np.cumsum(sizes) - sizes
        wide = sizes[of_a]
        at_a = np.repeat(np.arange(len(side_a)), wide)
        at_b = np.repeat(first[of_a] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        low = (1 << 32) - 1
        pairs = (side_a[at_a] & low) << 15 | (side_b[at_b] & low)
        lengths = np.bincount(unit_of_group[of_a[at_a]], minlength=len(units))
        self.pairs.extend(pairs.astype("<u4"), lengths)
        self.times.extend((many_a[at_a] * many_b[at_b]).astype("<u4"), lengths)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.good = np.concatenate([self.good, good])
        self.texts += self._spelled(flat_a, flat_b, group_a, group_b, unit_of_group, good)

    def _spelled(self, flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, unit_of_group: np.ndarray, good: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each unit; empty for a bad one."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        unit_ends = np.append(unit_of_group[1:] != unit_of_group[:-1], True)[: len(unit_of_group)]
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        sign_a = flat_a + size_a * last_a
        sign_b = flat_b + 2 * size_a + size_b * (last_b.astype(np.int64) + (last_b & unit_ends[group_b]))
        order = np.lexsort((np.arange(len(group_a) + len(group_b)), np.concatenate([group_a * 2, group_b * 2 + 1])))
        spelled = "".join(map(self.spelled.__getitem__, np.concatenate([sign_a, sign_b])[order].tolist())).split("\n")
        found = iter(spelled)
        return [next(found) if g else "" for g in good.tolist()]

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts: (n_a, n_b, n_groups, n_links) each, the spelled groups (None without tokens),
        and all linked pairs (A's id * 2^15 + B's), how often, and of which text, by text and pair."""
        if self.size > self.remembered:
            self._empty()
        found = [self.units.of(self.units_of(t)) if t else np.zeros(0, np.int64) for t in texts]
        if self.units.new:
            self._learn()
        fine = np.array([len(x) > 0 and bool(self.good[x].all()) for x in found])
        found = [x if f else x[:0] for x, f in zip(found, fine, strict=True)]
        counts = np.array([self.counts[x].sum(axis=0) for x in found]).reshape(-1, 4)
        spelled = [";".join(map(self.texts.__getitem__, x.tolist())) if f else None for x, f in zip(found, fine, strict=True)]
        flat = np.concatenate([*found, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        pairs, lengths = self.pairs.take(flat)
        times, _ = self.times.take(flat)
        key = np.repeat(owner, lengths) << 32 | pairs
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order].astype(np.int64)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        return counts, spelled, key[new] & ((1 << 32) - 1), np.add.reduceat(times, new) if len(new) else times, key[new] >> 32


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept between tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]
