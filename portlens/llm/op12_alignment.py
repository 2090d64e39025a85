"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes.

A is a byte-level tokenizer and reads the text with a space in front, B a piece tokenizer
that puts the space in front itself. The byte offsets where tokens of both end cut the
tokens into groups; every A token of a group is linked with every B token of it. The count
of an id pair is the number of documents that hold it linked.

A text that is null or empty, or whose tokens of either side spell other bytes than the
text with its space, has no tokens: its numbers are 0 and its digest is ''. Repeated rows
are documents of their own; null ids are passed through. An empty table has no rows. Extra
columns are left out.

External counting. A task takes its documents in chunks of bounded size. The records
(pair, document, times) of a chunk are sorted by pair and cut by the radix of A's id into
PARTS zstd runs: for each pair its documents, and their number. Numbers of pairs meet by
part, not their documents, so that a pair of every third document weighs no more than any
other: FAN runs of a part at a time are merged by a heap, in rounds, until each part has
one run. In a run the pairs of an A id follow each other, so that its highest count is
known when the run has passed it. Counts and whether they are the highest then go back,
pair by pair, to the chunks, which sum them over the records of their documents.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from portlens.llm.align_units import aligner
from portlens.llm.common import slices, stored, text_or_empty

PARTS = 128
FAN = 128  # runs that a task merges at once
CHUNK = 16 << 20  # bytes of text
BLOCK = 1 << 16  # numbers in a frame of a run
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_BLOBS = ("pairs", "holders", "documents", "times")
_STRIDE = -(-(1 << 16) // PARTS)


def packed(values: np.ndarray) -> bytes:
    """Ascending or plain whole numbers as frames of BLOCK: steps, byte by byte of their rank, in zstd."""
    frames = []
    for at in range(0, len(values), BLOCK):
        steps = np.diff(values[at : at + BLOCK].astype(np.int64), prepend=0)
        planes = zstandard.ZstdCompressor(level=3).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())
        frames.append(struct.pack("<I", len(planes)) + planes)
    return b"".join(frames)


def frames(blob: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(blob):
        (size,) = struct.unpack_from("<I", blob, at)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + size]), np.uint8)
        yield np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())
        at += 4 + size


def unpacked(blob: bytes) -> np.ndarray:
    return np.concatenate([*frames(blob), np.zeros(0, np.int64)])


def _coded(pairs: np.ndarray) -> np.ndarray:
    """Pairs in the order of their part, A's id and B's."""
    a = pairs >> 15
    return ((a % PARTS) * _STRIDE + a // PARTS) << 15 | pairs & 0x7FFF


_ROWS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in _NUMBERS], ("groups_sha256", pa.string()), *[(b, pa.binary()) for b in _BLOBS]])
_ROWS_SQL = f"chunk long, part int, number long, doc_id long, {', '.join(f'{n} long' for n in _NUMBERS)}, groups_sha256 string, {', '.join(f'{b} binary' for b in _BLOBS)}"


def _chunk(name: int, ids: list, counts: list[np.ndarray], digests: list[str], records: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the chunk's documents, and its runs."""
    n = len(ids)
    numbers = np.concatenate(counts)
    none = [pa.nulls(n, pa.binary())] * len(_BLOBS)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.nulls(n, pa.int32()), pa.array(np.arange(n)), pa.array(ids, pa.int64()), *[pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(4)], pa.array(digests, pa.string()), *none], schema=_ROWS)
    pairs, times, owner = (np.concatenate(x) for x in zip(*records, strict=True))
    key = _coded(pairs) << 32 | owner
    order = np.argsort(key)
    key, times = key[order], times[order]
    pair, owner = key >> 32, key & ((1 << 32) - 1)
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    holders = np.diff(np.append(starts, len(pair)))
    part = pair[starts] // (_STRIDE << 15)
    for p in np.unique(part).tolist():
        low, high = np.searchsorted(part, [p, p + 1])
        first, last = starts[low], starts[high] if high < len(starts) else len(pair)
        # Documents by their steps: the first of a pair goes back to the start.
        blobs = (packed(pair[starts[low:high]]), packed(holders[low:high]), packed(owner[first:last]), packed(times[first:last]))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([p], pa.int32()), *[pa.nulls(1, pa.int64())] * 6, pa.nulls(1, pa.string()), *[pa.array([b], pa.binary()) for b in blobs]], schema=_ROWS)


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their numbers (`part` is null) and the runs of their chunks, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        name = TaskContext.get().partitionId() << 32
        ids, counts, digests, records, size = [], [], [], [], 0
        for batch in slices(batches, 256):
            texts = batch.column("text").to_pylist()
            numbers, spelled, pairs, times, owner = align.aligned(texts)
            records.append((pairs, times, owner + len(ids)))
            ids += batch.column("doc_id").to_pylist()
            counts.append(numbers)
            digests += ["" if s is None else sha256(s.encode()).hexdigest() for s in spelled]
            size += sum(map(len, texts))
            if size > CHUNK:
                yield from _chunk(name, ids, counts, digests, records)
                name += 1
                ids, counts, digests, records, size = [], [], [], [], 0
        if ids:
            yield from _chunk(name, ids, counts, digests, records)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(texts.mapInArrow(run, _ROWS_SQL), "runs")


_RUN = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("holders", pa.binary())])


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run out of several, their equal pairs added up; only a frame of each is open at a time."""

    def stream(pairs: bytes, holders: bytes) -> Iterator[tuple[int, int]]:
        for p, h in zip(frames(pairs), frames(holders), strict=True):
            yield from zip(p.tolist(), h.tolist(), strict=True)

    runs = [stream(p, h) for batch in batches for p, h in zip(batch.column("pairs").to_pylist(), batch.column("holders").to_pylist(), strict=True)]
    pairs, holders = [], []
    now = -1
    for pair, n in heapq.merge(*runs):
        if pair == now:
            holders[-1] += n
        else:
            pairs.append(pair)
            holders.append(n)
            now = pair
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()]), pa.array([packed(np.array(pairs, np.int64))], pa.binary()), pa.array([packed(np.array(holders, np.int64))], pa.binary())], schema=_RUN)


def _group(groups: int) -> F.Column:
    return F.pmod(F.xxhash64("chunk"), F.lit(groups))


def counted(runs: DataFrame, n_chunks: int) -> DataFrame:
    """(part, pairs, holders): one run a part, with the number of documents of every pair."""
    level, n = runs, n_chunks
    while True:
        groups = max(1, -(-n // FAN))
        level = level.select("part", _group(groups).alias("chunk"), "pairs", "holders").groupBy("part", "chunk").applyInArrow(_merged, "part int, chunk long, pairs binary, holders binary")
        level = stored(level, "merged")
        if groups == 1:
            return level.drop("chunk")
        n = groups


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each run of a part, the counts of its pairs and whether they are their A id's highest."""
    out = []
    if right.num_rows:
        pairs, counts = (unpacked(right.column(c)[0].as_py()) for c in ("pairs", "holders"))
        starts = np.flatnonzero(np.diff(pairs >> 15, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(pairs))))
        best = counts == highest
        for chunk, part, own in zip(*(left.column(c).to_pylist() for c in ("chunk", "part", "pairs")), strict=True):
            at = np.searchsorted(pairs, unpacked(own))
            out.append((chunk, part, packed(counts[at]), packed(best[at])))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["chunk", "part", "counts", "best"])


def answers(runs: DataFrame, totals: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, part, counts, best) of every run; a part's totals go to each FAN of its runs."""
    groups = max(1, -(-n_chunks // FAN))
    asked = runs.select("part", "chunk", "pairs", _group(groups).alias("salt")).groupBy("part", "salt")
    known = totals.select("part", "pairs", "holders", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("salt")).groupBy("part", "salt")
    return asked.cogroup(known).applyInArrow(_answered, "chunk long, part int, counts binary, best binary")


_RESULT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in (*_NUMBERS, "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk with the sums over their records."""
    documents, runs, told = [], [], {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] is None:
                documents.append(row)
            elif row["counts"] is None:
                runs.append(row)
            else:
                told[row["part"]] = row["counts"], row["best"]
    best, total = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
    for run in runs:
        counts, highest = map(unpacked, told[run["part"]])
        holders, owner, times = (unpacked(run[c]) for c in ("holders", "documents", "times"))
        np.add.at(total, owner, np.repeat(counts, holders) * times)
        np.add.at(best, owner, np.repeat(highest, holders) * times)
    documents.sort(key=lambda d: d["number"])
    own = [[d[c] for d in documents] for c in ("doc_id", *_NUMBERS)]
    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in own], pa.array(best), pa.array(total), pa.array([d["groups_sha256"] for d in documents], pa.string())], schema=_RESULT)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = chunks(docs, path_a, path_b)
    runs = found.where("part is not null")
    n_chunks = found.where("part is null").select("chunk").distinct().count()
    told = answers(runs, counted(runs.select("part", "chunk", "pairs", "holders"), n_chunks), n_chunks)
    every = found.drop("pairs").unionByName(told, allowMissingColumns=True)
    shape = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _RESULT)
    return every.groupBy("chunk").applyInArrow(_summed, shape)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, documents): all linked id pairs with the number of documents that hold them."""
    found = chunks(docs, path_a, path_b)
    n_chunks = found.where("part is null").select("chunk").distinct().count()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("documents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, holders in zip(batch.column("pairs").to_pylist(), batch.column("holders").to_pylist(), strict=True):
                for p, h in zip(frames(pairs), frames(holders), strict=True):
                    code = p >> 15
                    yield pa.RecordBatch.from_arrays([pa.array(code % _STRIDE * PARTS + code // _STRIDE), pa.array(p & 0x7FFF), pa.array(h)], schema=schema)

    totals = counted(found.where("part is not null").select("part", "chunk", "pairs", "holders"), n_chunks)
    return totals.select("pairs", "holders").mapInArrow(run, "a long, b long, documents long")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame) -> DataFrame:
    return alignment(docs, *default_paths())
