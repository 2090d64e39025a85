"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed (128 bits). The first occurrence
of a window is the one with the smallest (doc_id, text hash, line number), null ids
last. Every later occurrence covers its three lines; the covered positions of a text
are merged and those lines removed, the rest joined again.

Texts of fewer than three lines have no window and stay as they are; a null text
stays null. Rows that equal each other in id and text stand for one occurrence, the
first of them by their other columns; the others lose every line if they have three or more. Extra columns
stay as they are, but for names of result columns (n_lines, n_removed), which are
replaced.

Shuffles: windows pre-aggregate before theirs. Of the repeated ones, those with 1/HOT of
all windows or more, at most HOT, go to every task, so that their places stay where they
are; the others meet their places by hash. Covered positions meet their text by (doc_id,
text hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from portlens.llm.common import DOCUMENT, other_columns, stored

SIZE = 3
HOT = 2000
SEED = 7


def _keys() -> list:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")]


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: the text's key, the window's first line number and its hash."""
    step = docs.where("text is not null").select(*_keys(), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= SIZE)
    line = lambda i: [F.get(F.col("lines"), i + k) for k in range(SIZE)]
    found = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SIZE),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*line(i)).alias("h1"), F.xxhash64(F.lit(SEED), *line(i)).alias("h2")),
    )
    return step.select("no_id", "id", "text_hash", F.inline(found))


def covered(docs: DataFrame) -> DataFrame:
    """Line numbers that later occurrences of a window cover, per text."""
    all_windows = stored(windows(docs), "windows")
    place = F.struct("no_id", "id", "text_hash", "at")
    firsts = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("k"))
    repeated = stored(firsts.where(F.col("first") != F.col("last")).select("h1", "h2", "first", "k"), "repeated")
    hot = F.col("k") * HOT >= all_windows.count()
    by_all = F.broadcast(repeated.where(hot).select("h1", "h2", "first"))
    others = all_windows.join(by_all, ["h1", "h2"], "left_anti").join(repeated.where(~hot).select("h1", "h2", "first"), ["h1", "h2"])
    later = all_windows.join(by_all, ["h1", "h2"]).unionByName(others).where(place != F.col("first"))
    merged = F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + (SIZE - 1)))))
    return later.groupBy("no_id", "id", "text_hash").agg(merged.alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with `text` cleaned, and n_lines, n_removed (long; 0 for a null text)."""
    results = ("n_lines", "n_removed")
    names = [c for c in docs.columns if c not in results]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_keys())
    joined = keyed.join(covered(docs), ["no_id", "id", "text_hash"], "left")
    copy = F.row_number().over(Window.partitionBy("no_id", "id", "text_hash").orderBy(*other_columns(docs.select(*[F.col(f"`{c}`") for c in names]))))
    joined = joined.withColumn("copy", copy).withColumn("lines", F.split("row.text", "\n", -1))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    gone = F.when((F.col("copy") > 1) & (F.size("lines") >= SIZE), every).otherwise(F.coalesce("covered", F.array().cast("array<int>")))
    joined = joined.withColumn("gone", gone)
    kept = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    # The size of a null array is -1.
    return joined.select(*columns, F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; those left without any text go."""
    done = dedup_lines(docs.select(*DOCUMENT))
    left = done.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))
