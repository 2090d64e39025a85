"""Quality rules, line first: bad lines go, then documents that lost too much.

Every line is judged alone: by its punctuation, by signs of a navigation bar and by
boilerplate phrases. Failing lines are removed. A document is kept if its basic
measures are sound and the failing lines held no more than a stated share of its
characters. Everything is a DataFrame expression on one row; nothing is shuffled.

Nulls: a null text counts as empty (no words, so rejected); other nulls pass through.
Lines without a word neither fail nor count. Repeated rows are judged alike. Extra
columns stay; one that has the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens.llm.common import DOCUMENT, text_or_empty, words_of

# Word lists and character classes of the rules.
SYMBOLS = r"[#*$%&|<>]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
BARS = r"[|»›•·]+"
# A line is a sentence, a heading or a list item if it ends in one of these.
ENDINGS = ".!?:;,)]\"'…”’»。！？"
MENU = (
    "home", "about", "about us", "contact", "contact us", "login", "log in", "logout", "log out", "sign in", "sign up", "menu", "search", "next",
    "previous", "back", "share", "sitemap", "read more", "skip to content", "subscribe", "help", "faq",
)
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "we use cookies", "accept cookies",
    "accept all cookies", "enable javascript", "licensed under", "licenced under", "copyright (c)", "copyright ©", "click here to", "lorem ipsum",
)
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MAX_MARKS = 20  # percent of a line's characters that may be punctuation
LONG_LINE = 12  # words from which a line needs an ending
MAX_LOST = 30  # percent of a document's characters that failing lines may hold


def removed_chars(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_facts(x: Column) -> Column:
    """What the rules need of a line (line, n, body), each taken once."""
    body = x["body"]
    return F.struct(
        x["line"].alias("line"),
        x["n"].alias("n"),
        (F.length(body) - F.greatest(x["n"] - 1, F.lit(0))).alias("solid"),
        removed_chars(body, PUNCTUATION).alias("marks"),
        removed_chars(body, BARS).alias("bars"),
        F.substring(body, -1, 1).alias("end"),
        F.lower(body).alias("body"),
    )


def line_fails(facts: Column) -> Column:
    """Why a line goes: too much punctuation or a long line without an end, a bar of links, a stock phrase."""
    of = facts.getField
    punctuation = (100 * of("marks") > MAX_MARKS * of("solid")) & (of("solid") > 3)
    endless = (of("n") >= LONG_LINE) & (F.instr(F.lit(ENDINGS), of("end")) == 0)
    navigation = ((of("bars") >= 2) & (4 * of("bars") >= of("n") - of("bars"))) | ((of("n") <= 3) & F.rtrim(of("body"), F.lit(".:!")).isin(*MENU))
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | F.contains(of("body"), F.lit(words))
    return (of("n") > 0) & (punctuation | endless | navigation | phrase)


def _each_window(words: Column, value) -> Column:
    """The value of every three consecutive words."""
    last = F.size(words) - 3
    at = lambda i, k: F.get(words, i + k)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: value(at(i, 0), at(i, 1), at(i, 2), i)))


def _equal_neighbours(ordered: Column) -> Column:
    """Entries whose key the entry before or after has too."""
    key = lambda i: F.get(ordered, i).getField("key")
    return F.filter(ordered, lambda s, i: s["key"].eqNullSafe(key(i - 1)) | s["key"].eqNullSafe(key(i + 1)))


def measure(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text."""
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in results]).alias("row")
    step = docs.select(carried, text_or_empty().alias("t"))
    pairs = F.transform(F.split("t", "\n", -1), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    step = step.withColumn("pairs", pairs)
    joined = lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), F.array_join(x["words"], " ").alias("body"))
    step = step.select("row", "t", F.flatten("pairs.words").alias("words"), F.transform("pairs", joined).alias("lines"))
    step = step.withColumn("facts", F.transform("lines", line_facts))
    # Hashes tell which windows may be repeated; the words themselves decide.
    words = F.col("words")
    step = step.withColumn("hashes", _each_window(words, lambda a, b, c, i: F.xxhash64(a, b, c)))
    pair = lambda h, i: F.struct(h.alias("key"), i.alias("i"))
    ordered = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", pair)))
    step = step.withColumn("ordered", ordered).withColumn("likely", _equal_neighbours(F.col("ordered")))
    spelled = lambda s: F.struct(F.concat_ws(" ", *[F.get(words, s["i"] + k) for k in range(3)]).alias("key"), s["i"].alias("i"))
    step = step.withColumn("spelled", F.sort_array(F.transform("likely", spelled)))
    step = step.withColumn("twice", _equal_neighbours(F.col("spelled")))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    step = step.withColumn("solid_lines", F.transform(F.filter("facts", lambda x: x["n"] > 0), lambda x: x["line"]))
    step = step.withColumn("judged", F.transform("facts", lambda x: F.struct(x["line"].alias("line"), x["solid"].alias("solid"), line_fails(x).alias("fails"))))
    good = F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"])
    step = step.select(
        "row",
        F.when(F.exists("judged", lambda x: x["fails"]), F.array_join(good, "\n")).otherwise(F.col("t")).alias("clean_text"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda n, x: n + x["solid"]).alias("word_chars"),
        removed_chars(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("solid_lines") - F.size(F.array_distinct("solid_lines"))).cast("long").alias("n_dup_lines"),
        F.greatest(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda n, x: n + F.when(x["fails"], x["solid"]).otherwise(0)).alias("lost_chars"),
    )
    step = step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    step = step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("word_chars")))
    return step.select("row.*", *results)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, with the columns of the input."""
    judged = measure(docs.select(*DOCUMENT))
    document = F.struct("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"), "kept")
    # As a generator: a plain filter would be pushed down and the measures written out in it over and over.
    return judged.select(F.inline_outer(F.when(F.col("kept"), F.array(document)))).where("kept").drop("kept")


def query(docs: DataFrame) -> DataFrame:
    return measure(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

