"""Packing into fixed windows by the online sum-of-squares rule.

A document is its token ids and the end id. Whole windows are cut off a long one; the
rest is placed in the fill level that makes the sum of the squared counts of partially
filled windows smallest, over an array that counts open windows by level. A window is
given out when it is full. What is open when a task's documents end is cut: those
pieces follow each other into full windows, the last of them into windows whose lengths
are powers of two, so nothing is padded.

Every task packs the documents of its own input split: nothing is shuffled, and a
repeated task gives the same rows. A task holds the level array and its open windows.

Nulls: a null text has the end id alone; a null doc_id stays null. Repeated rows are
packed once for each row. An empty table has no windows. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from portlens.llm.common import rows, slices
from portlens.llm.tokens import END_ID, default_path, word_tokens

WINDOW = 4096
_BYTES = 4
_END = np.array([END_ID], dtype="<u4").tobytes()


class Levels:
    """Counts of open windows by fill level, and the windows themselves."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece into the best level; the window if that fills it."""
        n = self.counts
        low = n[: self.window - size + 1]
        # Change of the sum: (N(h) - 1)^2 - N(h)^2 for the level left, (N(h + s) + 1)^2 - N(h + s)^2 for the one entered.
        change = np.where(low > 0, 2 * (n[size:] - low) + 2, np.iinfo(np.int64).max)
        change[0] = 2 * n[size] + 1
        if low[-1] > 0 or size == self.window:
            change[-1] = (1 - 2 * low[-1]) if size < self.window else 0
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            held = self.open[level].pop()
            n[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            return held
        n[level + size] += 1
        self.open.setdefault(level + size, []).append(held)
        return None

    def rest(self) -> list[tuple]:
        """The pieces of the open windows, fullest first."""
        return [piece for level in sorted(self.open, reverse=True) for held in self.open[level] for piece in held]


def _lengths(total: int, window: int) -> Iterator[int]:
    """Window lengths that hold so many ids without padding."""
    while total >= window:
        yield window
        total -= window
    while total:
        part = 1 << (total.bit_length() - 1)
        yield part
        total -= part


def _cut(pieces: list[tuple], window: int) -> Iterator[list[tuple]]:
    """Lay pieces (doc_id, start, ids, doc_tokens) end to end and cut them into windows."""
    queue = list(reversed(pieces))
    for length in _lengths(sum(len(p[2]) for p in pieces) // _BYTES, window):
        held, space = [], length
        while space:
            doc_id, start, ids, total = queue.pop()
            n = len(ids) // _BYTES
            if n > space:
                queue.append((doc_id, start + space, ids[space * _BYTES :], total))
                ids, n = ids[: space * _BYTES], space
            held.append((doc_id, start, ids, total))
            space -= n
        yield held


def packed_windows(documents: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Windows of pieces for (doc_id, ids as bytes) in the order given."""
    levels = Levels(window)
    for doc_id, ids in documents:
        total = len(ids) // _BYTES
        start = 0
        while total - start >= window:
            yield [(doc_id, start, ids[start * _BYTES : (start + window) * _BYTES], total)]
            start += window
        if start < total:
            full = levels.place((doc_id, start, ids[start * _BYTES :], total), total - start)
            if full:
                yield full
    yield from _cut(levels.rest(), window)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place there, window and place in it; `ids` as little-endian 32-bit numbers."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    names = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = word_tokens(path)
        for batch in slices(batches, 256):
            encoded = encoder.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                yield doc_id, ids.tobytes() + _END

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), *fields, *([("ids", pa.binary())] if with_ids else [])])
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for held in packed_windows(documents(again()), window):
            offset = 0
            for doc_id, start, ids, total in held:
                n = len(ids) // _BYTES
                out.append((doc_id, start, n, zlib.crc32(ids), total, number, offset, *([bytes(ids)] if with_ids else [])))
                offset += n
            number += 1
            if len(out) >= 2000:
                yield rows(schema, zip(*out, strict=True))
                out = []
        if out:
            yield rows(schema, zip(*out, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, names)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
