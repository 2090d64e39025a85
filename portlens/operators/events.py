"""Profiler records to uniform workload events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.text import ColumnOrName, blank, col, iso_text, lookup

EVENT_COLUMNS = (
    "event_key",
    "ts",
    "db_name",
    "collection_name",
    "op",
    "command_name",
    "command_doc",
    "duration_ms",
    "docs_examined",
    "keys_examined",
    "nreturned",
    "err_code",
    "err_msg",
)


def namespace_parts(ns: ColumnOrName, fallback_db: ColumnOrName | None = None) -> Column:
    """Struct (db_name, collection_name), split at the first dot."""
    text = blank(ns)
    dot = F.instr(text, ".")
    db = F.when(dot > 0, F.substring_index(text, ".", 1)).otherwise("")
    if fallback_db is not None:
        db = F.coalesce(F.nullif(db, F.lit("")), blank(fallback_db))
    collection = F.when(dot > 0, F.substr(text, dot + 1)).otherwise("")
    return F.struct(db.alias("db_name"), collection.alias("collection_name"))


def _is_document(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()


def _with_target(command: str, collection: Column, tail: Column) -> Column:
    """JSON text {command: collection, ...tail}; the tail brings its own comma."""
    head = F.regexp_replace(F.to_json(F.struct(collection.alias(command))), r"\}$", "")
    return F.concat(head, tail, F.lit("}"))


def command_document(
    command: ColumnOrName,
    query: ColumnOrName,
    updateobj: ColumnOrName,
    op: ColumnOrName,
    collection: ColumnOrName,
    legacy_detection: bool = False,
) -> Column:
    """One command document per record, in the shape drivers send today.

    Old profilers log queries, updates and removes outside `command`. Records
    that log a bare `{q, u}` under `command` get the same wrapping unless
    `legacy_detection` asks for them to be taken literally.
    """
    command, query, updateobj, op, collection = map(blank, (command, query, updateobj, op, collection))
    given = F.coalesce(F.size(F.json_object_keys(command)) > 0, F.lit(False))
    query_doc = F.when(_is_document(query), query).otherwise("{}")
    update_doc = F.when(_is_document(updateobj), updateobj).otherwise("{}")
    names_command = F.arrays_overlap(
        F.json_object_keys(query_doc), F.lit(["find", "aggregate", "count", "distinct"])
    )

    def updates(item: Column) -> Column:
        return _with_target("update", collection, F.concat(F.lit(',"updates":['), item, F.lit("]")))

    def deletes(item: Column) -> Column:
        return _with_target("delete", collection, F.concat(F.lit(',"deletes":['), item, F.lit("]")))

    pair = F.concat(F.lit('{"q":'), query_doc, F.lit(',"u":'), update_doc, F.lit("}"))
    only_q = F.concat(F.lit('{"q":'), query_doc, F.lit("}"))
    taken = command
    if not legacy_detection:
        keys = F.json_object_keys(command)
        bare = F.array_contains(keys, "q") & ~F.arrays_overlap(keys, F.lit(list(fixed.KNOWN_COMMANDS)))
        taken = F.when((op == "update") & bare, updates(command)).when((op == "remove") & bare, deletes(command)).otherwise(command)
    return (
        F.when(given, taken)
        .when((op == "query") & names_command, query_doc)
        .when(op == "query", _with_target("find", collection, F.concat(F.lit(',"filter":'), query_doc)))
        .when(op == "update", updates(pair))
        .when(op == "remove", deletes(only_q))
        .when(op == "insert", _with_target("insert", collection, F.lit("")))
        .when(query_doc != "{}", query_doc)
        .otherwise(update_doc)
    )


def command_name(doc: ColumnOrName, op: ColumnOrName, legacy_detection: bool = False) -> Column:
    """Command a document runs.

    `findAndModify` documents also hold an `update` key, so they are looked
    for first; `legacy_detection` keeps the older order that reports `update`.
    """
    known = list(fixed.KNOWN_COMMANDS)
    if not legacy_detection:
        known.sort(key=lambda name: name != "findAndModify")
    keys = F.json_object_keys(col(doc))
    named = F.get(F.array_intersect(F.lit(known), keys), F.lit(0))
    candidates = F.filter(
        F.transform(keys, F.trim),
        lambda k: (k != "") & ~k.isin(*fixed.COMMAND_METADATA_KEYS) & ~k.startswith("$"),
    )
    return F.coalesce(named, F.get(candidates, F.lit(0)), lookup(F.trim(blank(op)), fixed.COMMAND_BY_OPERATION, "unknown"))


def normalize_events(profile: DataFrame, legacy_detection: bool = False) -> DataFrame:
    """Profiler records (see README for the columns) to workload events."""
    has_db = "db" in [name.lower() for name in profile.columns]
    placed = profile.withColumn("_place", namespace_parts("ns", "db" if has_db else None))
    shaped = placed.select(
        "event_key",
        "ts",
        F.col("_place.db_name"),
        F.col("_place.collection_name"),
        blank("op").alias("op"),
        command_document("command", "query", "updateobj", "op", "_place.collection_name", legacy_detection).alias("command_doc"),
        F.col("millis").try_cast("bigint").alias("duration_ms"),
        F.col("docsExamined").try_cast("bigint").alias("docs_examined"),
        F.col("keysExamined").try_cast("bigint").alias("keys_examined"),
        F.col("nreturned").try_cast("bigint").alias("nreturned"),
        F.col("errCode").try_cast("bigint").alias("err_code"),
        F.nullif(blank("errMsg"), F.lit("")).alias("err_msg"),
    )
    return shaped.withColumn("command_name", command_name("command_doc", "op", legacy_detection)).select(*EVENT_COLUMNS)


def event_table(events: DataFrame) -> DataFrame:
    """Flat event listing: ISO time text, blank error text, no documents."""
    return events.select(
        F.coalesce(iso_text("ts"), F.lit("")).alias("ts"),
        "db_name",
        "collection_name",
        "op",
        "command_name",
        "duration_ms",
        "docs_examined",
        "keys_examined",
        "nreturned",
        "err_code",
        blank("err_msg").alias("err_msg"),
    )
