"""Training-order materialisation: token sequences in a keyed pseudorandom order.

Each task lays the ids of its documents end to end, an end id after each, and cuts
them into sequences of a fixed length; the last is filled up with end ids. Sequences
are numbered through, and a Feistel permutation with cycle walking takes each number
to its global slot. Slots are dealt by range to shards of a fixed number of sequences
with a fixed stride, so sequence k of a shard starts at byte k * stride and a reader
goes on at any slot.

Result: one row per shard: shard, first_slot, n_sequences, stride_bytes, n_tokens
(without filling), payload_crc32, payload (16-bit little-endian ids).

A null text counts as empty (its end id stays); doc_id and extra columns are not used;
repeated rows are repeated text; an empty table has no shards. Counts per task and one
number per task come to the driver, never rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from portlens.llm.common import rows, slices, stored
from portlens.llm.permute import permuted
from portlens.llm.tokens import END_ID, default_path, word_tokens

SEQUENCE = 1024
SHARD = 256
KEY = 20_24


def sequences(docs: DataFrame, path: str, length: int) -> DataFrame:
    """(part, number, n_tokens, ids): the sequences of each task, numbered within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = word_tokens(path), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())])
        held = np.zeros(0, "<u2")

        def cut(ids: np.ndarray, start: int, counts: list[int]) -> pa.RecordBatch:
            n = len(counts)
            return rows(schema, ([part] * n, range(start, start + n), counts, [row.tobytes() for row in ids.reshape(n, length)]))

        for batch in slices(batches, 256):
            encoded = [np.append(ids, END_ID).astype("<u2") for ids in encoder.encode(batch.column("text").to_pylist())]
            held = np.concatenate([held, *encoded])
            n = len(held) // length
            if n:
                yield cut(held[: n * length], number, [length] * n)
                held, number = held[n * length :].copy(), number + n
        if len(held):
            yield cut(np.append(held, np.full(length - len(held), END_ID, "<u2")), number, [len(held)])

    return docs.select("text").mapInArrow(run, "part int, number long, n_tokens int, ids binary")


def slotted(parts: DataFrame, key: int) -> DataFrame:
    """(slot, n_tokens, ids): every sequence with its place in the training order."""
    spark = parts.sparkSession
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, before long")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), total, key))

    numbered = parts.join(F.broadcast(offsets), "part")
    return numbered.select(slot(F.col("before") + F.col("number")).alias("slot"), "n_tokens", "ids")


def materialise(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, per_shard: int = SHARD, key: int = KEY) -> DataFrame:
    stride = 2 * length
    parts = stored(sequences(docs, path or default_path(), length), "sequences")
    dealt = slotted(parts, key).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    ordered = dealt.repartitionByRange("shard").sortWithinPartitions("shard", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int32()), ("stride_bytes", pa.int32()), ("n_tokens", pa.int64()), ("payload_crc32", pa.int64()), ("payload", pa.binary())])
        current, held, tokens = -1, [], 0

        def shard() -> pa.RecordBatch:
            payload = b"".join(held)
            return rows(schema, ([current], [current * per_shard], [len(held)], [stride], [tokens], [zlib.crc32(payload)], [payload]))

        for batch in batches:
            for number, n, ids in zip(batch.column("shard").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if number != current:
                    if held:
                        yield shard()
                    current, held, tokens = number, [], 0
                held.append(ids)
                tokens += n
        if held:
            yield shard()

    return ordered.select("shard", "slot", "n_tokens", "ids").mapInArrow(run, "shard long, first_slot long, n_sequences int, stride_bytes int, n_tokens long, payload_crc32 long, payload binary")


def read_from(spark: SparkSession, folder: str, slot: int) -> DataFrame:
    """(slot, ids) from a slot on, out of shards written as Parquet; earlier shards are not read."""
    shards = spark.read.parquet(folder).where(F.col("first_slot") + F.col("n_sequences") > slot)
    each = shards.select("payload", "stride_bytes", "first_slot", F.posexplode(F.sequence(F.lit(0), F.col("n_sequences") - 1)).alias("k", "_"))
    ids = F.substring(F.col("payload"), F.col("k") * F.col("stride_bytes") + 1, F.col("stride_bytes"))
    return each.select((F.col("first_slot") + F.col("k")).alias("slot"), ids.alias("ids")).where(F.col("slot") >= slot)


def query(docs: DataFrame) -> DataFrame:
    return materialise(docs)
