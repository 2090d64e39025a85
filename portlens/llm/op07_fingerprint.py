"""Document fingerprints: one-permutation MinHash with optimal densification.

Every five-word shingle is hashed once; the high bits choose one of BINS bins, the rest
is the value, and a bin keeps its least value. An empty bin copies from the bin that a
hash of (bin, attempt) names, the first that is not empty; the hash does not depend on
the text, so equal sets fill alike. A fingerprint keeps the low BITS bits of every bin,
packed, as hexadecimal text. The share m of equal bins over-counts by chance equality
C = 2^-BITS; likeness is (m - C) / (1 - C), at least 0.

A text without words (or null) has the empty fingerprint: like itself 1, like any other 0.
Repeated rows have equal fingerprints. For the next document, ids ascend, null ids come
last, equal ids go by the text's hash. An empty table has no rows. Extra columns are
left out of the query; `fingerprints` keeps them, replacing one named fingerprint.

The next document: texts are dealt by ranges of (id, text hash) and sorted; a task sees
its neighbours, and hands out its first and last text, which meet in a small second step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from portlens.llm.common import rows, slices, stored
from portlens.llm.shingles import mixed, shingle_hashes

BINS = 256
BITS = 4
_EMPTY = np.uint64(2**64 - 1)


def _densified(least: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (rows without any value stay)."""
    full = least != _EMPTY
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = np.uint64(0)
    while len(row):
        attempt += np.uint64(1)
        with np.errstate(over="ignore"):
            source = (mixed(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(BINS)).astype(np.int64)
        hit = full[row, source]
        least[row[hit], bin_[hit]] = least[row[hit], source[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return least


def packed(texts: list[str | None]) -> list[bytes]:
    """The fingerprints of texts; b"" for a text without words."""
    hashes, owner = shingle_hashes(texts)
    least = np.full((len(texts), BINS), _EMPTY, dtype=np.uint64)
    shift = np.uint64(64 - (BINS - 1).bit_length())
    np.minimum.at(least, (owner, (hashes >> shift).astype(np.int64)), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    some = (least != _EMPTY).any(axis=1)
    low = (_densified(least) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(texts), -1)
    return [row.tobytes() if ok else b"" for row, ok in zip(np.packbits(bits, axis=1), some, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, BITS).any(axis=1)
    chance = 2.0**-BITS
    return float(max(0.0, ((1 - differ.mean()) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents and their `fingerprint`."""
    names = [c for c in docs.columns if c != "fingerprint"]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = kept.schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [f.hex() for f in packed(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "fingerprint"])

    return kept.mapInArrow(run, schema)


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_NAMES = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], followers: list[str], marks: list[bytes], next_marks: list[bytes]) -> list[tuple]:
    """The result columns of texts and the texts that follow them."""
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + f[:h] for t, f, h in zip(texts, followers, halves, strict=True)]
    edited_marks = packed(edited)
    return [
        (len(t), hashlib.sha256(e.encode()).hexdigest(), m, em, likeness(m, em), likeness(m, nm))
        for t, e, m, em, nm in zip(texts, edited, marks, edited_marks, next_marks, strict=True)
    ]


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, schema = TaskContext.get().partitionId(), None, None
        for batch in slices(batches, 128):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            marks = packed(texts)
            schema = pa.schema([("edge", pa.int32()), ("part", pa.int32()), ("doc_id", batch.schema.field("doc_id").type), *_FIELDS, ("text", pa.string())])
            blank = (None,) * len(_FIELDS)
            if held is None:
                yield rows(schema, zip((1, part, None, *blank, texts[0]), strict=True))
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
            held = ids[-1], texts[-1], marks[-1]
            found = _compared(texts[:-1], texts[1:], marks[:-1], marks[1:])
            if found:
                yield rows(schema, zip(*[(0, part, i, *f, None) for i, f in zip(ids, found, strict=False)], strict=True))
        if held:
            yield rows(schema, zip((2, part, held[0], *blank, held[1]), strict=True))

    spark = docs.sparkSession
    done = stored(ordered.mapInArrow(run, f"edge int, part int, doc_id {kind}, {_NAMES}, text string"), "neighbours")
    # Part numbers alone come to the driver, one for each task.
    parts = sorted(r["part"] for r in done.where("edge = 1").select("part").collect())
    after = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    heads = done.where("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("follower"))
    tails = done.where("edge = 2").select("part", "doc_id", "text").join(F.broadcast(after), "part").join(heads, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts, followers = batch.column("text").to_pylist(), batch.column("follower").to_pylist()
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *_FIELDS])
            found = _compared(texts, followers, packed(texts), packed(followers))
            if found:
                yield rows(schema, zip(*[(i, *f) for i, f in zip(batch.column("doc_id").to_pylist(), found, strict=True)], strict=True))

    last = tails.select("doc_id", "text", "follower").mapInArrow(finish, f"doc_id {kind}, {_NAMES}")
    inner = done.where("edge = 0").select(*last.columns)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    both = inner.unionByName(last)
    return both.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")


def query(docs: DataFrame) -> DataFrame:
    return neighbours(docs)
