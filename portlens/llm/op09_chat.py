r"""Chat formatting with a grammar round trip.

Grammar of the output, read from left to right without looking ahead:

    conversation := turn*
    turn         := "[INST] " role " [/INST]" text "</s>"

Inside a role or text a backslash makes the next character ordinary. A turn is
first written as it is and read again; if what comes back differs from the source,
its control strings are escaped, and if it still differs, its backslashes too. That
last form always comes back. Turns that need no escape keep their exact text.

One row per conversation: conv_id, formatted, loss_spans (start and length, in code
points, of every assistant text as written), n_turns, round_trip. Turns are ordered
by turn, then role, then text; null turns come first, repeated rows are repeated turns.
A null role or text is empty. Rows with a null conv_id form one conversation. Extra
columns are ignored. Escaping and its check run on single turns before the only
shuffle, which brings the turns of a conversation together: its text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, HEAD_END, CLOSE = "[INST] ", " [/INST]", "</s>"
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>")
LEARNED = "assistant"
PIECE = 1024


def _control_escaped(text: Column) -> Column:
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def _all_escaped(text: Column) -> Column:
    return _control_escaped(F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD_END), text, F.lit(CLOSE))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text as (role, text); a null turn where the grammar is broken."""
    pieces = F.split(formatted, CLOSE, -1)
    closed = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.locate(HEAD_END, piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
        text = F.substring(piece, end + len(HEAD_END), F.length(piece))
        return F.when(
            F.startswith(piece, F.lit(OPEN)) & (end > len(OPEN)),
            F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")),
        )

    return F.when(F.element_at(pieces, -1) == "", F.transform(closed, turn))


def format_chat(turns: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    step = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    role, text = F.col("role"), F.col("text")
    source = F.array(F.struct("role", "text"))
    for name, change in (("plain", lambda c: c), ("control", _control_escaped), ("full", _all_escaped)):
        step = step.withColumn(f"{name}_role", change(role)).withColumn(f"{name}_text", change(text))
    same = lambda name: parsed(_rendered(F.col(f"{name}_role"), F.col(f"{name}_text"))).eqNullSafe(source)
    pick = F.when(same("plain"), "plain").when(same("control"), "control").otherwise("full")
    step = step.withColumn("form", pick)
    chosen = lambda part: F.when(F.col("form") == "plain", F.col(f"plain_{part}")).when(F.col("form") == "control", F.col(f"control_{part}")).otherwise(F.col(f"full_{part}"))
    step = step.select("conv_id", "turn", "role", "text", chosen("role").alias("written_role"), chosen("text").alias("written_text"))
    step = step.withColumn("written", _rendered(F.col("written_role"), F.col("written_text")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    step = step.withColumn("number", F.row_number().over(before))
    start = F.sum(F.length("written").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    head = F.length("written_role") + len(OPEN) + len(HEAD_END)
    step = step.withColumn("start", F.coalesce(start, F.lit(0)) + head).withColumn("length", F.length("written_text").cast("long"))
    whole = step.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "role", "text", "written", "start", "length"))).alias("all"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["written"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda t: t["role"] == LEARNED), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    whole = whole.withColumn("read_back", parsed(F.col("formatted")))
    return whole.select("conv_id", "formatted", "loss_spans", "read_back", F.size("read_back").cast("long").alias("n_turns"), F.col("read_back").eqNullSafe(F.col("source")).alias("round_trip"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text that the spans cover, without escapes; cut out of pieces of PIECE, so that a long text is not counted through for each."""
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, span: Column) -> Column:
        start, end = span["start"].cast("int"), (span["start"] + span["length"]).cast("int")
        first = F.floor(start / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
        return unescaped(F.substring(near, start % PIECE + 1, end - start))

    return F.get(F.transform(F.array(pieces), lambda p: F.array_join(F.transform(spans, lambda span: cut(p, span)), "")), F.lit(0))


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted text says when it is read again, and what its loss mask covers."""
    learned = under_mask(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("read_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", "n_turns", "formatted", said.alias("said"), learned.alias("learned"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def query(turns: DataFrame) -> DataFrame:
    """All conversations and one whose texts hold control strings."""
    spark = turns.sparkSession
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return digest(format_chat(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))
