"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of 0-9, a-z (A-Z lower-cased) and anything beyond ASCII. The index is cut
by documents into segments of bounded size; each holds its terms with their postings (the
places of a term in the segment, ascending) and its documents with their place. A place
is left free between two documents, so that no phrase crosses them.

A query is a list of terms. `search` orders each query's terms by their number of places
in the whole index and intersects the lists, shifted by the term's offset, from the rarest
on; what remains are the starts of exact occurrences. `proximity` finds the stretches of
at most `within` words of one document that hold all terms of a query in any order.

Windows are ten consecutive words of an item, or all of an item with fewer. A null or
wordless text has no words, windows or hits. Rows of one item_id are one item; a null
item_id is an item with the empty name. Repeated documents are reported each, null ids too.
An empty documents table has no rows; an empty benchmark hits nothing. Extra columns are
left out.

How it runs: one scan writes the index, without a shuffle. A search reads the postings of
the query terms and brings those of a segment together, in memory bounded by the
segment's size. Queries go to the tasks in blocks of bounded size, however many they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from portlens.llm.common import slices, stored, text_or_empty
from portlens.llm.tokens import Numbers

WINDOW = 10
SEGMENT = 8 << 20  # bytes of text
BLOCK = 100_000  # queries that go to a task at once
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_INDEX = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("places", pa.binary()), ("number", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])
_INDEX_SQL = "segment long, term string, n long, places binary, number long, doc_id long, start long"


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TO_SPACE).split()


def _segment(name: int, ids: list[int | None], found: list[np.ndarray], terms: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of the segment's documents, then of its terms in their order."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    none = pa.nulls(len(ids), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name)), none, pa.array(lengths), pa.nulls(len(ids), pa.binary()), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64()), pa.array(starts)], schema=_INDEX)
    order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    numbers = rank[np.concatenate([*found, np.zeros(0, np.int64)])]
    places = np.arange(len(numbers)) + np.repeat(np.arange(len(found)), lengths)
    by_term = np.argsort(numbers, kind="stable")
    places = places[by_term].astype("<u4")
    ends = np.cumsum(np.bincount(numbers, minlength=len(terms)))
    # Each list is its first place and the steps to the next ones.
    steps = np.diff(places, prepend=places[:1] * 0).astype("<u4")
    steps[ends[:-1]] = places[ends[:-1]]
    for at in range(0, len(terms), 50_000):
        to = min(at + 50_000, len(terms))
        cuts = np.concatenate([ends[at - 1 : at] if at else [0], ends[at:to]])
        offsets = ((cuts - cuts[0]) * 4).astype(np.int32)
        lists = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(steps[cuts[0] : cuts[-1]].tobytes())])
        spelled = pa.array([terms[i] for i in order[at:to].tolist()], pa.binary()).cast(pa.string())
        blank = pa.nulls(to - at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, name)), spelled, pa.array(np.diff(cuts)), lists, blank, blank, blank], schema=_INDEX)


def index(docs: DataFrame) -> DataFrame:
    """The stored index of documents.

    Rows of terms have (segment, term, n, places), rows of documents (segment, number,
    doc_id, start, n); the number counts the documents of a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        numbers, ids, found, size = Numbers(), [], [], 0
        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                found.append(numbers.of(words(text)))
                size += len(text)
            if size > SEGMENT:
                yield from _segment(name, ids, found, numbers.take_new())
                name, numbers, ids, found, size = name + 1, Numbers(), [], [], 0
        if ids:
            yield from _segment(name, ids, found, numbers.take_new())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(texts.mapInArrow(run, _INDEX_SQL), "postings")


class Segment:
    """Postings and documents of one segment, as a search needs them."""

    def __init__(self, table: pa.Table) -> None:
        terms, n, lists = (table.column(c).to_pylist() for c in ("term", "n", "places"))
        self.lists = {t: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(terms, lists, strict=True) if t is not None}
        found = sorted((s, k, d) for s, k, d, t in zip(table.column("start").to_pylist(), table.column("number").to_pylist(), n, terms, strict=True) if t is None)
        self.starts, self.numbers, self.lengths = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def row(self, places: np.ndarray) -> np.ndarray:
        """The document that a place lies in, by rank of its start."""
        return np.searchsorted(self.starts, places, "right") - 1

    def exact(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """Starts of the phrase whose (term, offset) come rarest first."""
        starts = None
        for term, offset in terms:
            places = self.lists.get(term)
            if places is None:
                return np.zeros(0, np.int64)
            if starts is None:
                starts = places - offset
            elif len(starts):
                at = np.minimum(np.searchsorted(places, starts + offset), len(places) - 1)
                starts = starts[places[at] == starts + offset]
            if not len(starts):
                return starts
        return starts

    def near(self, terms: list[tuple[str, int]], within: int) -> np.ndarray:
        """(first, last) places of shortest stretches with all terms, one for each first place."""
        lists = [self.lists.get(t) for t in dict.fromkeys(t for t, _ in terms)]
        if any(x is None for x in lists):
            return np.zeros((0, 2), np.int64)
        # A stretch holds a place of the rarest term, so it begins shortly before one.
        rare = lists[0]
        first = np.unique(np.concatenate(lists))
        after = rare[np.minimum(np.searchsorted(rare, first), len(rare) - 1)]
        first = first[(after >= first) & (after < first + within)]
        last = first
        for places in lists:
            at = np.searchsorted(places, first)
            next_one = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], np.iinfo(np.int64).max)
            last = np.maximum(last, next_one)
        fits = (last - first < within) & (self.row(first) == self.row(last))
        return np.stack([first[fits], last[fits]], axis=1)


def _matcher(shared: Broadcast, match: Callable) -> Callable:
    """Matches of the queries, given by their rarest term, in a segment."""
    schema = pa.schema([("segment", pa.int64()), ("number", pa.int64()), ("query", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(pa.Table.from_batches(list(batches)))
        out: list[list] = [[], [], [], []]
        for rarest, its in shared.value.items():
            if rarest not in segment.lists:
                continue
            for query, order in its:
                places = match(segment, order, len(order))
                if len(places):
                    row = segment.row(places[:, 0])
                    begin = segment.starts[row]
                    out[0].append(segment.numbers[row])
                    out[1] += [query] * len(row)
                    out[2].append(places[:, 0] - begin)
                    out[3].append(places[:, 1] - begin)
        if out[0]:
            number, first, last = (np.concatenate(out[k]) for k in (0, 2, 3))
            name = np.full(len(number), key[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(number), pa.array(out[1], pa.string()), pa.array(first), pa.array(last)], schema=schema)

    return run


def _searched(found: DataFrame, queries: DataFrame, match: Callable[[Segment, list[tuple[str, int]], int], np.ndarray]) -> DataFrame:
    """(segment, number, query, first, last) of matches; places count from the document's first word."""
    shape = "segment long, number long, query string, first long, last long"
    blocks = queries.count() // BLOCK + 1
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    every = []
    for block in range(blocks):
        some = dealt.where(F.col("block") == block)
        terms = F.broadcast(some.select(F.explode("terms").alias("term")).distinct())
        totals = found.where("term is not null").join(terms, "term").groupBy("term").agg(F.sum("n").alias("total"))
        # At most BLOCK queries with their terms.
        count = {r["term"]: r["total"] for r in totals.collect()}
        by_rarest = defaultdict(list)
        for r in some.select("query", "terms").collect():
            if all(t in count for t in r["terms"]):
                order = sorted(((t, k) for k, t in enumerate(r["terms"])), key=lambda x: (count[x[0]], x))
                by_rarest[order[0][0]].append((r["query"], order))
        shared = found.sparkSession.sparkContext.broadcast(dict(by_rarest))

        postings = found.where("term is not null").join(terms, "term").select(*_INDEX.names)
        rows = postings.unionByName(found.where("term is null").select(*_INDEX.names))
        every.append(rows.groupBy("segment").applyInArrow(_matcher(shared, match), shape))
    return reduce(DataFrame.unionByName, every)


def search(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact occurrences of queries (query, terms) in an index: (segment, number, query, first, last)."""

    def match(segment: Segment, order: list[tuple[str, int]], size: int) -> np.ndarray:
        starts = segment.exact(order)
        return np.stack([starts, starts + size - 1], axis=1)

    return _searched(found, queries, match)


def proximity(found: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Stretches of at most `within` words that hold all terms of a query: (segment, number, query, first, last)."""
    return _searched(found, queries, lambda segment, order, _: segment.near(order, within))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, query, terms): the distinct windows of each item; a query is its terms with spaces between."""
    low = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    step = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(low, F.lit(WORD), 0).alias("all")).where(F.size("all") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("all") - WINDOW + 1, F.lit(1)))
    terms = step.select("item", F.explode(F.transform(begins, lambda i: F.slice("all", i, WINDOW))).alias("terms"))
    return terms.select("item", F.array_join("terms", " ").alias("query"), "terms").distinct()


def _union_length(pairs: Column) -> Column:
    """Words that (first, last) stretches cover together."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to"))

    def step(s: Column, p: Column) -> Column:
        new = F.greatest(p["last"] - F.greatest(s["to"], p["first"] - 1), F.lit(0))
        return F.struct((s["n"] + new).alias("n"), F.greatest(s["to"], p["last"]).alias("to"))

    return F.aggregate(F.array_sort(pairs), state, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = index(docs)
    windows = stored(item_windows(items), "windows")
    place = ["segment", "number"]
    hits = stored(search(found, windows.select("query", "terms").distinct()), "hits")
    # Stretches are merged by their start first: a text has at most as many as it has words.
    ends = hits.groupBy(*place, "first").agg(F.max("last").alias("last"))
    covered = ends.groupBy(*place).agg(_union_length(F.collect_list(F.struct("first", "last"))).alias("n_hit"))
    named = hits.select(*place, "query").distinct().join(windows.select("query", "item"), "query").select(*place, "item").distinct()
    named = named.groupBy(*place).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    every = found.where("term is null").select(*place, "doc_id", F.col("n").alias("n_words"))
    joined = every.join(covered.join(named, place), place, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    sha = F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256)
    return joined.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), sha.alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items)
