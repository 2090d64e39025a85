"""Usage roll-up of workload events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens.functions.text import blank, iso_text
from portlens.operators.tally import counted_features
from portlens.operators.walk import command_parts, feature_names, feature_nodes
from portlens.session import BROADCAST_KEYS, BROADCAST_ROWS, durable

USAGE_KEYS = ("feature_type", "feature_name", "command_name", "op_type", "database", "collection")
USAGE_COLUMNS = (*USAGE_KEYS, "usage_count", "first_seen", "last_seen", "max_duration_ms", "sample_path", "sample_value")

_TOP_KEY = 9223372036854775807
# One more than the range of a 64-bit key, so that no key reaches into the time.
_SPAN = "18446744073709551616"


def _one_per_row(array: Column) -> Column:
    """Unnest an array that is costly to compute.

    The outer form computes it once per row; for the inner form the optimizer
    adds a filter on its size, which computes it again. Rows of empty arrays
    come out as NULL and are to be filtered.
    """
    return F.inline_outer(array)


def _with_uses(events: DataFrame) -> DataFrame:
    """Events with `_uses`: each feature of the event once, with how often it occurs there."""
    read = events.withColumn("_read", counted_features("command_doc", "command_name"))
    left = F.col("_read").isNull()
    read = read.withColumn("_parts", F.when(left, command_parts("command_doc")))
    read = read.withColumn("_all", F.when(left, feature_names("command_doc", "command_name", "_parts")))
    times = F.transform(
        F.array_distinct("_all"),
        lambda f: F.struct(f.feature_type.alias("feature_type"), f.feature_name.alias("feature_name"), F.size(F.filter("_all", lambda x: x == f)).cast("bigint").alias("n")),
    )
    return read.withColumn("_uses", F.coalesce("_read", times)).drop("_read", "_parts", "_all")


def features(events: DataFrame) -> DataFrame:
    """One row per use of a feature."""
    each = F.transform("_uses", lambda f: F.array_repeat(F.struct(f.feature_type.alias("feature_type"), f.feature_name.alias("feature_name")), f.n.cast("int")))
    return (
        _with_uses(events)
        .select(
            "event_key",
            "ts",
            "duration_ms",
            "command_name",
            F.col("op").alias("op_type"),
            F.col("db_name").alias("database"),
            F.col("collection_name").alias("collection"),
            _one_per_row(F.flatten(each)),
        )
        .filter(F.col("feature_name").isNotNull())
    )


def feature_totals(events: DataFrame) -> DataFrame:
    """Uses of each feature and events that have it, counted inside each event first."""
    each = _with_uses(events).select(_one_per_row(F.col("_uses"))).filter(F.col("feature_name").isNotNull())
    return each.groupBy("feature_type", "feature_name").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("events"))


def feature_details(events: DataFrame) -> DataFrame:
    """One row per use of a feature, with its path and value."""
    return events.select(
        "event_key",
        "ts",
        "command_name",
        F.col("op").alias("op_type"),
        _one_per_row(feature_nodes("command_doc", "command_name")),
    ).filter(F.col("feature_name").isNotNull())


def _recency() -> Column:
    """Newest event first, then the smallest key, as one number.

    A number keeps the roll-up a hash aggregation without strings in its
    buffers. Events without a time come last.
    """
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).cast("decimal(19,0)")
    return (
        micros.cast("decimal(38,0)") * F.lit(_SPAN).cast("decimal(20,0)")
        + (F.lit(_TOP_KEY).cast("decimal(20,0)") - F.col("event_key").cast("decimal(20,0)"))
    ).cast("decimal(38,0)")


def usage_counts(events: DataFrame) -> DataFrame:
    """Counts, time range and longest duration per feature and place of use.

    Uses are counted inside each event first. `sample_event` is the key of the
    newest event of the group.
    """
    placed = _with_uses(events).select(
        "ts",
        "duration_ms",
        "command_name",
        F.col("op").alias("op_type"),
        F.col("db_name").alias("database"),
        F.col("collection_name").alias("collection"),
        _recency().alias("_recency"),
        "_uses",
    )
    rolled = (
        placed.select(*[c for c in placed.columns if c != "_uses"], _one_per_row(F.col("_uses")))
        .filter(F.col("feature_name").isNotNull())
        .groupBy(*USAGE_KEYS)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("usage_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.max("duration_ms").alias("max_duration_ms"),
            F.max("_recency").alias("_recency"),
        )
    )
    newest = F.lit(_TOP_KEY).cast("decimal(20,0)") - F.pmod("_recency", F.lit(_SPAN).cast("decimal(20,0)"))
    kept = [c for c in rolled.columns if c != "_recency"]
    return rolled.select(*kept, newest.cast("bigint").alias("sample_event"))


def attach_samples(usage: DataFrame, events: DataFrame) -> DataFrame:
    """Path and value of each feature in its sample event; every usage row once.

    Only the sampled events are opened, and found without moving the others:
    by sending the usage rows to the executors while they are few, or else
    their event keys alone. Beyond that the tables are joined by key. Several
    events may have the sampled key (equal records have equal content keys);
    the first path counts. A group whose event is not found keeps its row. Pass
    `usage` stored (see `session.durable`), since it is read several times.
    """
    groups = usage.count()
    documents = events.select(F.col("event_key").alias("sample_event"), "command_doc")
    wanted = usage.select("sample_event", *USAGE_KEYS)
    if groups <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    elif groups <= BROADCAST_KEYS:
        documents = documents.join(F.broadcast(usage.select("sample_event").distinct()), "sample_event", "left_semi")
    joined = documents.join(wanted, "sample_event")
    mine = F.filter(
        feature_nodes("command_doc", "command_name"),
        lambda f: (f.feature_type == F.col("feature_type")) & (f.feature_name == F.col("feature_name")),
    )
    first = F.array_min(F.transform(mine, lambda f: F.struct(f.sample_path, f.sample_value)))
    found = joined.select(*[F.col(c).alias(f"_{c}") for c in USAGE_KEYS], first.alias("_sample"))
    found = found.groupBy(*[f"_{c}" for c in USAGE_KEYS]).agg(F.min("_sample").alias("_sample"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in USAGE_KEYS]
    return (
        usage.join(found, same, "left")
        .withColumns({"sample_path": F.col("_sample.sample_path"), "sample_value": F.col("_sample.sample_value")})
        .select(*USAGE_COLUMNS)
    )


def usage_rollup(events: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Usage table with one sample per group. `counted` are the same events, observed while they are counted."""
    return attach_samples(durable(usage_counts(events if counted is None else counted)), events)


def as_evidence(usage: DataFrame, source: str) -> DataFrame:
    """Usage rows in the shape shared by all evidence sources."""
    typed = dict(usage.dtypes)
    texts = {
        name: F.coalesce(iso_text(name), F.lit("")) if typed[name].startswith("timestamp") else blank(name)
        for name in ("first_seen", "last_seen")
    }
    kept = [texts[name].alias(name) if name in texts else F.col(name) for name in USAGE_COLUMNS if name in typed]
    return usage.select(*kept, F.lit(source).alias("evidence_source"))


def usage_order() -> list[Column]:
    """Most used first, then by name and place."""
    return [F.desc("usage_count"), *[F.asc(c) for c in ("feature_type", "feature_name", "database", "collection", "op_type")]]
