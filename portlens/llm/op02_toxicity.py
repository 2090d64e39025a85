"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Learning. Words (lower-cased, outer punctuation off) of the labelled training documents
are counted by class, once for each document; of documents with an equal text and an
equal label, one counts. A word's log-odds are its posterior under a Dirichlet prior whose
mean is the log-odds of its first five letters, theirs that of its first four, theirs 0,
so unseen forms of a known stem are scored by the stem. Only log-odds that differ from
their prior by Z standard errors enter the table; any other word takes the longest stem
in it, or 0. Z is the same at every size and the table holds every significant entry: one
of up to MAX_FEATURES entries is sent to every task; a larger one stays rows, and the
distinct words of the texts meet it by a join.

Scoring. A token's score is its log-odds less a constant drift. One pass over a text
finds all maximal scoring segments. A segment of score S in a text of n tokens has
E = K n exp(-lambda S): lambda solves E[exp(lambda score)] = 1 over clean training
tokens, K is fitted to the segments of clean training documents. The evidence of a text
is the sum of -ln E over its segments with E below 1; a logistic curve fitted on the
training documents turns evidence into a probability.

Labels, language, source and id are never inputs of a score. A null or empty text has no
segment and gets the score of no evidence. Repeated rows are scored alike; labels of one
id that differ count as toxic; null labels are ignored. An empty table has no rows;
without training labels every score is the prior's. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from portlens.llm.common import byte_words, remainder, rows, slices, stored, text_or_empty
from portlens.llm.tokens import Numbers

FOLDS = 5
STRENGTH = 5.0
Z = 3.5
DRIFT = 0.3
# Entries of a table that is sent to every task; a larger one is joined. Scores are the same.
MAX_FEATURES = 200_000
CHUNK_WORDS = 300_000
BROADCAST_LABELS = 2_000_000
REMEMBERED = 300_000
STEMS = (5, 4)
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BINS = 0.25


def _bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(_EDGES)


def one_of_copies(training: DataFrame) -> DataFrame:
    """Of rows with an equal text and an equal label, one; a text with both labels counts once for each."""
    return training.withColumn("copy", F.sha2(text_or_empty(), 256)).dropDuplicates(["copy", "toxic"]).drop("copy")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of either class that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            both: dict[str, list[int]] = {}
            for side in (0, 1):
                for word, n in counts[side].items():
                    both.setdefault(_bare(word), [0, 0])[side] += n
                counts[side].clear()
            return rows(schema, (both.keys(), [n[1] for n in both.values()], [n[0] for n in both.values()]))

        for batch in slices(batches, 256):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[1 if toxic else 0].update(set(byte_words(text)))
            if len(counts[0]) + len(counts[1]) > REMEMBERED:
                yield out()
        yield out()

    each = labelled.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    return each.where("word != ''").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _posterior(prior: Column, toxic_all: float, clean_all: float) -> tuple[Column, Column]:
    """Log-odds of a feature with counts toxic and clean, and their distance from the prior in standard errors."""
    share = F.lit(toxic_all) * F.exp(prior) / (F.lit(toxic_all) * F.exp(prior) + F.lit(clean_all))
    a, b = F.col("toxic") + STRENGTH * share, F.col("clean") + STRENGTH * (1 - share)
    odds = F.log(a / b) - math.log(toxic_all / clean_all)
    return odds, (odds - prior) / F.sqrt(1 / a + 1 / b)


def log_odds(words: DataFrame) -> tuple[DataFrame, float]:
    """(level, feature, odds, z, clean): words and their stems; and the number of clean tokens."""
    totals = words.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic_all, clean_all = float(totals[0] or 0) + 1, float(totals[1] or 0) + 1
    parent, levels = None, []
    for size in reversed(STEMS):
        level = words.groupBy(F.substring("word", 1, size).alias("feature")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        parent = _level(level, parent, size, toxic_all, clean_all)
        levels.append((size, parent))
    levels.append((0, _level(words.withColumnRenamed("word", "feature"), parent, 0, toxic_all, clean_all, STEMS[0])))
    out = None
    for size, level in levels:
        part = level.select(F.lit(size).alias("level"), "feature", "odds", "z")
        out = part if out is None else out.unionByName(part)
    return out, clean_all


def _level(level: DataFrame, parent: DataFrame | None, size: int, toxic_all: float, clean_all: float, longest: int = 0) -> DataFrame:
    if parent is None:
        prior = level.withColumn("prior", F.lit(0.0))
    else:
        stem = longest or STEMS[-1]
        above = parent.select(F.col("feature").alias("stem"), F.col("odds").alias("prior"))
        prior = level.withColumn("stem", F.substring("feature", 1, stem)).join(above, "stem").drop("stem")
    odds, z = _posterior(F.col("prior"), toxic_all, clean_all)
    return prior.withColumn("odds", odds).withColumn("z", z)


class Weights:
    """Scores of words by the table of significant features."""

    def __init__(self, features: list[tuple[int, str, float]], drift: float) -> None:
        self.tables = {size: {f: odds for level, f, odds in features if level == size} for size in (0, *STEMS)}
        self.drift = drift

    def odds(self, word: bytes) -> float:
        bare = _bare(word)
        if not bare:
            return 0.0
        for size in (0, *STEMS):
            found = self.tables[size].get(bare[:size] if size else bare)
            if found is not None:
                return found
        return 0.0


class _Remembered(dict):
    def __init__(self, weights: Weights) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        odds = self[word] = self.weights.odds(word)
        return odds


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of scores less drift, in one pass.

    Tokens are taken one positive at a time; the tokens between two only lower the sum.
    A list holds candidate segments with the sums before and after them, and for each
    the place of the nearest earlier one with a smaller sum before it. A new segment
    goes back along these places, so that none is passed twice, and joins those back to
    the nearest with a smaller sum before it.
    """
    held: list[tuple[int, int, float, float]] = []
    smaller: list[int] = []
    total = np.concatenate([[0.0], np.cumsum(scores - drift)])
    for at in np.flatnonzero(scores > drift).tolist():
        first, last, low, high = at, at + 1, float(total[at]), float(total[at + 1])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = smaller[j]
            if j < 0 or held[j][3] >= high:
                break
            first, low, before = held[j][0], held[j][2], smaller[j]
            del held[j:], smaller[j:]
            j = before
        held.append((first, last, low, high))
        smaller.append(j)
    return [(first, last, high - low) for first, last, low, high in held]


_ENTRY = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])
_ENTRIES = "array<struct<first:int,last:int,score:double>>"


def _entries(scores: np.ndarray, drift: float) -> list[dict]:
    return [{"first": a, "last": b, "score": s} for a, b, s in segments(scores, drift)]


def passages(docs: DataFrame, features: list[tuple[int, str, float]], drift: float = DRIFT) -> DataFrame:
    """(doc_id, n_tokens, segments): the toxic-leaning passages of whole texts, as word ranges with their scores."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered(Weights(shared.value, drift))
        for batch in slices(batches, 256):
            lengths, found = [], []
            for text in batch.column("text").to_pylist():
                words = byte_words(text)
                scores = np.fromiter(map(remembered.__getitem__, words), np.float64, len(words))
                lengths.append(len(words))
                found.append(_entries(scores, drift))
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("segments", pa.list_(_ENTRY))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(_ENTRY))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, segments {_ENTRIES}")


def word_odds(words: DataFrame, odds: DataFrame, small: bool) -> DataFrame:
    """Rows with a bare word, and its log-odds: its own, its longest stem's in the table, or 0."""
    found = []
    for size in (0, *STEMS):
        name = f"odds_{size}"
        level = odds.where(F.col("level") == size).select(F.col("feature").alias(f"stem_{size}"), F.col("odds").alias(name))
        key = F.substring("word", 1, size) if size else F.col("word")
        words = words.join(F.broadcast(level) if small else level, key == F.col(f"stem_{size}"), "left").drop(f"stem_{size}")
        found.append(name)
    return words.withColumn("odds", F.coalesce(*found, F.lit(0.0))).drop(*found)


def joined_passages(docs: DataFrame, odds: DataFrame, drift: float = DRIFT) -> DataFrame:
    """The same as passages, with a table that stays rows.

    A task numbers the words of its documents chunk by chunk; every distinct word meets the
    table once and its odds go back to the chunks that have it, whose documents are scored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, numbers, schema = TaskContext.get().partitionId() << 20, 0, Numbers(), None

        def words() -> pa.RecordBatch:
            n = len(numbers)
            return rows(schema, ([part + chunk] * n, [None] * n, [None] * n, range(n), map(_bare, numbers)))

        for batch in slices(batches, 256):
            schema = pa.schema([("chunk", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("numbers", pa.binary()), ("number", pa.int32()), ("word", pa.string())])
            index = [numbers.of(byte_words(text)).astype("<u4").tobytes() for text in batch.column("text").to_pylist()]
            numbers.new.clear()
            n = len(index)
            yield rows(schema, ([part + chunk] * n, batch.column("doc_id"), index, [None] * n, [None] * n))
            if len(numbers) > CHUNK_WORDS:
                yield words()
                chunk, numbers = chunk + 1, Numbers()
        if len(numbers):
            yield words()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        values = np.zeros(right.num_rows)
        values[right.column("number").to_numpy()] = right.column("odds").to_numpy()
        index = [np.frombuffer(x, "<u4") for x in left.column("numbers").to_pylist()]
        arrays = [left.column("doc_id").combine_chunks(), pa.array(map(len, index), pa.int64()), pa.array([_entries(values[x], drift) for x in index], pa.list_(_ENTRY))]
        return pa.Table.from_arrays(arrays, schema=pa.schema([("doc_id", left.schema.field("doc_id").type), ("n_tokens", pa.int64()), ("segments", pa.list_(_ENTRY))]))

    all_rows = stored(docs.select("doc_id", "text").mapInArrow(encode, f"chunk long, doc_id {kind}, numbers binary, number int, word string"), "encoded")
    places = all_rows.where("number is not null").groupBy("word").agg(F.collect_list(F.struct("chunk", "number")).alias("places"))
    valued = word_odds(places, odds, False).select("odds", F.inline("places")).withColumnRenamed("chunk", "piece")
    documents = all_rows.where("numbers is not null").select("chunk", "doc_id", "numbers")
    return documents.groupBy("chunk").cogroup(valued.groupBy("piece")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, segments {_ENTRIES}")


def solve_lambda(histogram: list[tuple[float, float]]) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over (score, count); 1 where no score is positive."""
    score, count = np.array([h[0] for h in histogram]), np.array([h[1] for h in histogram])
    if not len(score) or score.max() <= 0:
        return 1.0
    low, high = 0.0, 50.0
    for _ in range(200):
        middle = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (middle, high) if (count * np.exp(np.minimum(middle * score, 700))).sum() < count.sum() else (low, middle)
    return max(low, 0.05)


def logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through (evidence, toxic, clean) counts."""
    if not points:
        return -2.0, 1.0
    x, a, b = (np.array(c, dtype=float) for c in zip(*points, strict=True))
    design = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.array([1e-3, 1e-2])

    def loss(theta: np.ndarray) -> float:
        z = design @ theta
        return float((a * np.logaddexp(0, -z) + b * np.logaddexp(0, z)).sum() + (ridge * theta**2).sum() / 2)

    theta = np.array([math.log((a.sum() + 1) / (b.sum() + 1)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        gradient = design.T @ (a - (a + b) * p) - ridge * theta
        step = np.linalg.solve((design * ((a + b) * p * (1 - p))[:, None]).T @ design + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-6 and loss(theta + size * step) > loss(theta):
            size /= 2
        theta = theta + size * step
    return float(theta[0]), float(max(theta[1], 1e-3))


def evidence(rate: float, k: float) -> Column:
    """Sum of -ln E over the segments with E below 1."""
    log_e = lambda s: F.lit(rate) * s["score"] - F.log(F.lit(k) * F.col("n_tokens"))
    return F.aggregate("segments", F.lit(0.0), lambda t, s: t + F.greatest(log_e(s), F.lit(0.0)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, segments, evidence, score) of every document."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = _small(marked)
    training = docs.select("doc_id", "text").where(remainder("doc_id", FOLDS) != 0).join(marked, "doc_id")
    words = stored(word_counts(one_of_copies(training)), "words")
    odds, _ = log_odds(words)
    odds = stored(odds.where(F.abs("z") >= Z), "odds")
    small = odds.count() <= MAX_FEATURES
    if small:
        features = [tuple(r) for r in odds.select("level", "feature", "odds").collect()]
    found = stored(passages(docs, features) if small else joined_passages(docs, odds), "passages")
    rate = solve_lambda(_clean_scores(words, odds, small))
    training_scored = found.where(remainder("doc_id", FOLDS) != 0).join(marked, "doc_id")
    clean = training_scored.where("toxic = 0")
    typical = clean.select(F.explode("segments.score").alias("s")).agg(F.percentile_approx("s", 0.5), F.count("*")).first()
    tokens = clean.agg(F.sum("n_tokens")).first()[0]
    k = 0.5 * typical[1] / tokens * math.exp(min(rate * typical[0], 600)) if typical[1] and tokens else 0.01
    scored = training_scored.withColumn("bin", F.round(F.least(evidence(rate, k), F.lit(200.0)) / _BINS))
    points = [(r["bin"] * _BINS, r["a"], r["b"]) for r in scored.groupBy("bin").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b")).collect()]
    intercept, slope = logistic(points)
    done = found.withColumn("evidence", evidence(rate, k))
    probability = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.least("evidence", F.lit(200.0)))))
    return done.select("doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "segments", "evidence", probability.alias("score"))


def _small(frame: DataFrame) -> DataFrame:
    """An id and at most a flag for each row: sent to every executor while that is some tens of MB."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_LABELS else frame


def _clean_scores(words: DataFrame, odds: DataFrame, small: bool) -> list[tuple[float, float]]:
    """(score, count) of the clean training tokens, in steps of a hundredth."""
    each = word_odds(words, odds, small).groupBy(F.round(F.col("odds") - DRIFT, 2).alias("score")).agg(F.sum("clean"))
    return [tuple(r) for r in each.collect()]


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    done = score(docs, labels)
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
