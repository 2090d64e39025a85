"""Phrase collocation mining over a weighted de Bruijn graph.

A text is lower-cased (A-Z), cut at `. , ; : ! ?` and line ends into pieces, and those at
spaces and tabs into words. Every word occurrence is one edge: the word and the two after
it in its piece, where the piece's end stands for the missing ones. An edge leads from
the node of its first two words to the node of its last two. Shorter counts are sums of
flow: what leaves a node, piece ends included, is the count of its two words; what leaves
all nodes of a first word is the count of that word.

Candidates are phrases of 2 to 3 words that occur at least `least` times in their lang. A
candidate is cut after each word into a first part (l) and a rest (r) and scores
floor(1,000,000 * a * a / (l * r)) at its lowest cut, the earliest of equals. It is
dropped when a longer candidate that holds it has at least half its count. Edges joined
by nodes that pass on their whole flow are one unary path; `path_words` is the length of
the path that a phrase lies on.

A null text is empty, a null lang is `und`. Repeated rows count each time. Ties in score
and count go by the phrase in UTF-8 order. An empty table, or one without phrases, has no
rows. Extra columns are left out.

How it runs. One pass counts the words and gives each (lang, word) a 64-bit hash, checked
to be unlike all others; a second sends the edges as three hashes, added up in each task
first. Edges meet by their first word, so that one task has the flow of a word and of all
its nodes, and only what occurs `least` times goes on. A word that holds 1/(4 * parts) of
all words or more is heavy; these, at most 4 * parts, are known to every task. Their edges
are dealt by the second word too, and by the third where the second is heavy as well, and
partial sums of words and nodes are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from portlens.llm.common import rows, slices, stored, text_or_empty
from portlens.llm.shingles import mixed
from portlens.llm.tokens import Numbers

LEAST = 10
PER_LANG = 2000
PERCENT = 50
CHUNK = 24 << 20  # bytes of text a task counts at once
PART = 2_000_000  # words whose edges one task adds up
SHARE = 4  # a word is heavy from 1 / (SHARE * parts) of all words on
NO_LANG = "und"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_END = bytes.maketrans(_ENDS, b"." * len(_ENDS))
_EDGE = ["w1", "w2", "w3"]
_MAX_WORDS = 1 << 21  # up to here three numbers of words make one of 63 bits


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Word numbers of texts of one lang, with 0 at every piece's end, and the words by number."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def numbered() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        for lang, texts in held.items():
            numbers = Numbers()
            numbers.of([b"."])
            found = [numbers.of(text.split()) for text in texts]
            yield lang, np.concatenate([part for text in found for part in (text, np.zeros(1, np.int64))]), numbers.take_new()

    for batch in slices(batches, 256):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text.encode().lower().translate(_TO_END).replace(b".", b" . "))
            size += len(text)
        if size > CHUNK:
            yield from numbered()
            held, size = {}, 0
    yield from numbered()


def _hashes(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """A hash for each word number; the end's is 0."""
    start = lang.encode() + b"\0"
    found = np.fromiter((xxh3_64_intdigest(start + w, seed) for w in words), np.uint64, len(words)).view(np.int64)
    found[0] = 0
    return found


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n): all words with their number of occurrences."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in _chunks(batches):
            times = np.bincount(numbers, minlength=len(words))
            hashes = _hashes(lang, words, seed)
            order = sorted(range(1, len(words)), key=words.__getitem__)
            for at in range(0, len(order), 50_000):
                some = np.array(order[at : at + 50_000])
                yield rows(schema, ([lang] * len(some), [words[i].decode() for i in some.tolist()], hashes[some], times[some]))

    return _texts(docs).mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The counted words, stored, and a seed under which no two of them (nor a piece's end) have one hash."""
    for seed in range(100):
        words = stored(count_words(docs, seed), "words")
        if words.groupBy("hash").count().where("count > 1 or hash = 0").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def edges(docs: DataFrame, seed: int, heavy: np.ndarray, salts: int) -> DataFrame:
    """(w1, w2, w3, salt, n): edges added up in each task.

    `salt` is 0 for a light first word. For a heavy one it is a positive number by the second
    word, and where that is heavy too, a negative one by the second and third.
    """
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("salt", pa.int32()), ("n", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in _chunks(batches):
            size = len(words)
            first = numbers
            second = np.append(first[1:], 0)
            third = np.where(second == 0, 0, np.append(second[1:], 0))
            node = (first * size + second)[first != 0]
            names = None
            if size > _MAX_WORDS:
                names, node = np.unique(node, return_inverse=True)
            found, times = np.unique(node * size + third[first != 0], return_counts=True)
            hashes = _hashes(lang, words, seed)
            hot = np.isin(hashes, shared.value)
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                node, c = np.divmod(part, size)
                a, b = np.divmod(node if names is None else names[node], size)
                rest = mixed(np.where(hot[b], hashes[b] ^ (hashes[c] << 1), hashes[b]).view(np.uint64)) % np.uint64(salts)
                salt = np.where(hot[a], (1 + rest.astype(np.int64)) * np.where(hot[b], -1, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[a]), pa.array(hashes[b]), pa.array(hashes[c]), pa.array(salt.astype(np.int32)), pa.array(times[at : at + 100_000].astype(np.int32))], schema=schema)

    return _texts(docs).mapInArrow(run, "w1 long, w2 long, w3 long, salt int, n int")


def _sums(values: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of sorted rows by equal values."""
    new = reduce(np.logical_or, (np.diff(v, prepend=v[:1] - 1) != 0 for v in values))
    at = np.flatnonzero(new)
    return [v[at] for v in values], np.add.reduceat(times, at) if len(at) else times


def _met(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the edges of a task: those that occur `least` times, and the flow of nodes and words.

    A word or node that lies in several tasks gives what it has in each.
    """
    schema = pa.schema([("size", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(i).to_numpy() for i in range(5)] for batch in batches]
        if not held:
            return
        w1, w2, w3, salt, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((w3, w2, w1))
        w1, w2, w3, salt, n = w1[order], w2[order], w3[order], salt[order], n[order].astype(np.int64)
        (x, y, z), f = _sums([w1, w2, w3], n)
        nodes, node_flow = _sums([w1, w2, (salt < 0).astype(np.int8)], n)
        words, word_flow = _sums([w1, (salt != 0).astype(np.int8)], n)
        none = np.zeros(0, np.int64)
        for size, values, flow, some in (
            (3, (x, y, z), f, (f >= least) & (z != 0)),
            (2, (*nodes[:2], none), node_flow, ((node_flow >= least) | (nodes[2] > 0)) & (nodes[1] != 0)),
            (1, (words[0], none, none), word_flow, (word_flow >= least) | (words[1] > 0)),
        ):
            at = np.flatnonzero(some)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                filled = [v[part] if len(v) else np.zeros(len(part), np.int64) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), size, np.int32)), *map(pa.array, filled), pa.array(flow[part])], schema=schema)

    return run


def graph(docs: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """(size, w1, w2, w3, f): words, nodes and edges that occur `least` times; a missing word is 0.

    Those that hold a piece's end are left out at last: they are corrections to the
    flow and no phrases.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(16, total // PART + 1)
    heavy = np.array([r[0] for r in words.where(F.col("n") * (SHARE * parts) >= total).select("hash").collect()], np.int64)
    dealt = edges(docs, seed, heavy, SHARE * parts).repartition(parts, "w1", "salt")
    found = dealt.mapInArrow(_met(least), "size int, w1 long, w2 long, w3 long, f long")
    return found.groupBy("size", *_EDGE).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def unary_paths(grams: DataFrame) -> DataFrame:
    """(w1, w2, w3, path_words): every edge with the length in words of its unary path.

    Two edges are joined where the node between them gets its whole flow from the one
    and gives it to the other. There is no ring of such nodes, since every piece begins
    somewhere. Each round doubles the distance that an edge looks back.
    """
    edge = F.xxhash64(*_EDGE)
    found = grams.where("size = 3").select(*_EDGE, "f", edge.alias("edge"))
    nodes = grams.where("size = 2").select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("f").alias("g"))
    into = found.join(nodes, (F.col("w2") == F.col("x")) & (F.col("w3") == F.col("y")) & (F.col("f") == F.col("g"))).select("x", "y", F.col("edge").alias("up"))
    out = found.join(nodes, (F.col("w1") == F.col("x")) & (F.col("w2") == F.col("y")) & (F.col("f") == F.col("g"))).select("x", "y", "edge")
    back = stored(out.join(into, ["x", "y"]).select("edge", "up", F.lit(1).cast("long").alias("far")), "back")
    while True:
        above = back.select(F.col("edge").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"))
        joined = back.join(above, "up", "left")
        if joined.where("top is not null").isEmpty():
            break
        back = stored(joined.select("edge", F.coalesce("top", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "back")
    longest = back.groupBy("up").agg(F.max("far").alias("far"))
    named = found.join(back.select("edge", F.col("up").alias("head")), "edge", "left").withColumn("head", F.coalesce("head", "edge"))
    named = named.join(longest.withColumnRenamed("up", "head"), "head", "left")
    return named.select(*_EDGE, (F.coalesce("far", F.lit(0)) + 3).alias("path_words"))


def _counts(grams: DataFrame, size: int, names: list[str], f: str) -> DataFrame:
    return grams.where(F.col("size") == size).select(*[F.col(w).alias(n) for w, n in zip(_EDGE, names, strict=False)], F.col("f").alias(f))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)) in whole numbers of 38 digits: exact up to some 10^16 words."""
    whole = lambda c: c.cast("decimal(18,0)")
    over = (whole(a) * whole(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def candidates(grams: DataFrame) -> DataFrame:
    """(size, w1, w2, w3, a, l, r, score): every candidate at its lowest cut."""
    ones = lambda w, f: _counts(grams, 1, [w], f)
    twos = lambda x, y, f: _counts(grams, 2, [x, y], f)
    two = grams.where("size = 2").join(ones("w1", "l1"), "w1").join(ones("w2", "r1"), "w2")
    three = grams.where("size = 3").join(ones("w1", "l1"), "w1").join(twos("w2", "w3", "r1"), ["w2", "w3"])
    three = three.join(twos("w1", "w2", "l2"), ["w1", "w2"]).join(ones("w3", "r2"), "w3")

    def cut(k: int) -> Column:
        left, right = F.col(f"l{k}"), F.col(f"r{k}")
        return F.struct(_score(F.col("f"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    kept = ["size", *_EDGE, F.col("f").alias("a")]
    scored = two.select(*kept, cut(1).alias("cut")).unionByName(three.select(*kept, F.least(cut(1), cut(2)).alias("cut")))
    return scored.select("size", *_EDGE, "a", "cut.l", "cut.r", "cut.score")


def undropped(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Without two-word candidates inside a three-word one that has this share of their count."""
    three = found.where("size = 3")
    longer = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = found.where("size = 2").join(longer, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True)))
    return three.unionByName(two.select(*found.columns))


def collocations(docs: DataFrame, least: int = LEAST, per_lang: int | None = PER_LANG) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, path_words); the first `per_lang` of each lang, or all."""
    words, seed = dictionary(docs)
    grams = stored(graph(docs, words, seed, least), "grams")
    found = undropped(stored(candidates(grams), "candidates"))
    found = found.join(unary_paths(grams), _EDGE, "left").withColumn("path_words", F.coalesce("path_words", F.col("size").cast("long")))
    spelled = words.where(F.col("n") >= least).select("lang", "hash", "word")
    name = lambda w: spelled.select(F.col("hash").alias(w), F.col("word").alias(f"{w}_word"))
    found = found.join(spelled.select(F.col("hash").alias("w1"), "lang", F.col("word").alias("w1_word")), "w1")
    found = reduce(lambda frame, w: frame.join(name(w), w, "left"), ["w2", "w3"], found)
    found = found.withColumn("phrase", F.concat_ws(" ", "w1_word", "w2_word", "w3_word"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.select("lang", "phrase", "a", "l", "r", "score", "path_words")
    if per_lang is not None:
        # First in parts of a lang, so that no task ranks all its candidates.
        found = stored(found, "phrases")
        salt = F.pmod(F.xxhash64("phrase"), F.lit(found.count() // 100_000 + 1))
        near = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))
        found = found.withColumn("salt", salt).withColumn("near", near).where(F.col("near") <= per_lang).drop("salt", "near")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if per_lang is not None:
        found = found.where(F.col("rank") <= per_lang)
    found = found.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs).drop("path_words")
