"""Mixing sources to target weights, block by block.

The words of a source, its documents one after another, are cut into blocks of BLOCK
words. The mix is a row of slots in SHARDS output shards of equal length. For every
shard a multinomial draw says how many slots each source gets; its probabilities are
what is left of each source's target, so that the whole mix meets the targets. The
k-th slot of a source maps through a pseudorandom permutation of the source's block
numbers, keyed anew for each round through all blocks, and slots and blocks are joined
by (source, block). Slots inside a shard are permuted too. The last slot of a source takes
only as many words of its block as its target lacks, so that small sources meet theirs too
(beyond MANY blocks to within one block).

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share
SHARE of all words; a target ends at LIMIT times its source's words, and the excess is
shared by weight among the others until none is above. At most LIMIT rounds through a
source are taken, so no document is taken more often than that.

A document's size is its number of words (null text: 0). Documents without words are
taken 0 words and have a row all the same. Repeated rows are separate documents; null
doc_ids are ordinary. An empty table gives an empty mix. Extra columns are left out.

A source's documents are ordered by (bucket of the id's hash, id), and their positions
come from sums over buckets and a running sum inside each, so a source with a third of
all rows is spread over BUCKETS groups. Only per-source numbers come to the driver; more
than MAX_SOURCES sources are an error, as a weight for each must be stated somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from portlens.llm.common import DOCUMENT, count_words, rows, slices, stored
from portlens.llm.permute import permuted

BLOCK = 64
SHARDS = 256
BUCKETS = 1024
SHARE = 1.5
LIMIT = 2
WEIGHTS = (3, 1, 2)
MAX_SOURCES = 20_000
MANY = 1 << 16
SEED = 11
_WORDS = rb"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words wanted of each source: by weight, at most `limit` times its size, the excess reshared."""
    want = [0.0] * len(sizes)
    free, left = [i for i, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > limit * sizes[i]]
        for i in over or free:
            want[i] = float(limit * sizes[i]) if over else per * weights[i]
        if not over:
            break
        left -= sum(want[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return want


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws from what is left."""
    left = np.array(slots, dtype=np.int64)
    generator = np.random.default_rng(seed)
    counts = np.zeros((shards, len(slots)), dtype=np.int64)
    total = int(left.sum())
    for shard in range(shards):
        size = total * (shard + 1) // shards - total * shard // shards
        while size:
            some = np.minimum(generator.multinomial(size, left / left.sum()), left)
            counts[shard] += some
            left -= some
            size -= int(some.sum())
    return counts


def _key(source: int | np.ndarray, turn: int | np.ndarray, seed: int = SEED) -> int | np.ndarray:
    """Key of the permutation of a source's blocks in a round."""
    return (source + 1) * 131_071 + turn * 8_191 + seed


def _slots(source: int, size: int, target: int, blocks: int) -> tuple[int, int]:
    """Slots that give a source's target, and the words of the last one."""
    turns, left = divmod(target, size) if size else (0, 0)
    if not left:
        return turns * blocks, BLOCK
    if blocks > MANY:
        return turns * blocks + -(-left // BLOCK), left - (left - 1) // BLOCK * BLOCK
    order = permuted(np.arange(blocks), np.full(blocks, blocks), np.full(blocks, _key(source, turns)))
    ends = np.cumsum(np.where(order == blocks - 1, size - (blocks - 1) * BLOCK, BLOCK))
    last = int(np.searchsorted(ends, left))
    return turns * blocks + last + 1, left - (int(ends[last - 1]) if last else 0)


class Sources:
    """The per-source numbers: words, target, blocks and slots, in the order of the names."""

    def __init__(self, found: list[tuple[str | None, int]], share: float, limit: float, weights: tuple) -> None:
        if len(found) > MAX_SOURCES:
            raise ValueError(f"{len(found)} sources; at most {MAX_SOURCES} can be weighted")
        found = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
        self.names = [name for name, _ in found]
        self.sizes = [int(n) for _, n in found]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(found))], share, limit)
        self.blocks = [-(-n // BLOCK) for n in self.sizes]
        # Slots of each source, and the words that its last one takes.
        ends = [_slots(i, n, round(t), b) for i, (n, t, b) in enumerate(zip(self.sizes, self.targets, self.blocks, strict=True))]
        self.slots, self.cuts = [e[0] for e in ends], [e[1] for e in ends]

    def frame(self, spark: SparkSession) -> DataFrame:
        listed = [(i, *x) for i, x in enumerate(zip(self.names, self.sizes, self.targets, strict=True))]
        return spark.createDataFrame(listed, "_source int, _name string, source_size long, target double")


def placed(docs: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple = WEIGHTS) -> tuple[DataFrame, Sources]:
    """The documents with _source, _size, _position (the words before them in their source), and the sources."""
    spark = docs.sparkSession
    own = ("_position", "_size", "_source", "_bucket", "_before", "_hash", "source_size", "target")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    sized = kept.withColumn("_size", count_words(F.col("text"))).withColumn("_hash", F.xxhash64("text"))
    sized = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(BUCKETS)).cast("int"))
    per_bucket = stored(sized.groupBy("source", "_bucket").agg(F.sum("_size").alias("_size")), "buckets")
    sources = Sources([tuple(r) for r in per_bucket.groupBy("source").agg(F.sum("_size")).collect()], share, limit, weights)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    named = sources.frame(spark).select("_source", F.col("_name").alias("source"), "source_size", "target")
    before = before.join(F.broadcast(named), before["source"].eqNullSafe(named["source"])).select(before["source"].alias("_name"), F.col("_bucket").alias("_b"), "_before", "_source", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("doc_id", "_size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("_position", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = running.join(before, F.col("source").eqNullSafe(F.col("_name")) & (F.col("_bucket") == F.col("_b")))
    joined = joined.withColumn("_position", F.col("_position") + F.col("_before"))
    return joined.drop("_bucket", "_before", "_hash", "_name", "_b"), sources


def slots(spark: SparkSession, sources: Sources, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, slot, _source, block, round, words): what every slot of the mix takes, at most so many words of a block."""
    counts = draw(sources.slots, shards, seed)
    before = np.cumsum(counts, axis=0) - counts
    ends = np.cumsum(counts, axis=1)
    starts = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    blocks = np.array(sources.blocks, dtype=np.int64)
    last, cuts = np.array(sources.slots, dtype=np.int64) - 1, np.array(sources.cuts, dtype=np.int64)
    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int64()), ("_source", pa.int32()), ("block", pa.int64()), ("round", pa.int32()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            shard = np.searchsorted(starts, number, side="right") - 1
            inside = number - starts[shard]
            place = permuted(inside, starts[shard + 1] - starts[shard], shard + seed * 1_000_003)
            source, rank = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for s in np.unique(shard):
                at = shard == s
                source[at] = np.searchsorted(ends[s], place[at], side="right")
                rank[at] = place[at] - (ends[s] - counts[s])[source[at]] + before[s][source[at]]
            turn, index = np.divmod(rank, blocks[source])
            block = permuted(index, blocks[source], _key(source, turn, seed))
            yield rows(schema, (shard, inside, source, block, turn, np.where(rank == last[source], cuts[source], BLOCK)))

    return spark.range(int(starts[-1])).mapInArrow(run, "shard int, slot long, _source int, block long, round int, words long")


def blocks_of(documents: DataFrame) -> DataFrame:
    """One row per block and document in it: the document's words from `first` to before `last`."""
    end = F.col("_position") + F.col("_size")
    numbers = F.sequence(F.floor(F.col("_position") / BLOCK), F.floor((end - 1) / BLOCK))
    each = documents.where("_size > 0").select("_source", "_position", "_size", F.explode(numbers).alias("block"))
    first = F.greatest(F.col("block") * BLOCK - F.col("_position"), F.lit(0))
    last = F.least((F.col("block") + 1) * BLOCK - F.col("_position"), F.col("_size"))
    return each.select("_source", "_position", "block", first.alias("first"), last.alias("last"))


def taken(documents: DataFrame, sources: Sources) -> DataFrame:
    """(_source, _position, round, first, last, shard, slot): the words that slots take of each document."""
    mix = slots(documents.sparkSession, sources)
    end = F.least(F.col("last"), F.col("block") * BLOCK + F.col("words") - F.col("_position"))
    return blocks_of(documents).join(mix, ["_source", "block"]).withColumn("last", end).where("last > first").drop("words")


def query(docs: DataFrame) -> DataFrame:
    documents, sources = placed(docs.select("doc_id", "text", "source"))
    documents = stored(documents.drop("text"), "placed")
    words = taken(documents, sources).groupBy("_source", "_position").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    full = documents.where("_size > 0").join(words, ["_source", "_position"], "left")
    none = documents.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    both = full.select(*none.columns).unionByName(none)
    return both.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each round, the words taken of a document, in their order, as one row."""
    documents, sources = placed(docs.select(*DOCUMENT))
    documents = stored(documents, "placed")
    spans = taken(documents.drop("text"), sources).groupBy("_source", "_position", "round").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    joined = documents.where("_size > 0").join(spans, ["_source", "_position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(_WORDS)
        for batch in slices(batches, 256):
            texts = []
            for text, pieces in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                starts = [0, *[m.start() for m in word.finditer(data)][1:], len(data)]
                texts.append(b"".join(data[starts[p["first"]] : starts[p["last"]]] for p in pieces).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array(map(len, texts), pa.int64())], names=list(DOCUMENT))

    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*DOCUMENT).schema}
    return joined.select(*DOCUMENT, "spans").mapInArrow(run, ", ".join(f"{c} {'long' if c == 'n_chars' else kinds[c]}" for c in DOCUMENT))
