"""Global log lines to usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portlens import fixed
from portlens.functions.text import ColumnOrName, blank, col
from portlens.operators.events import namespace_parts
from portlens.sources.profile import is_system_database


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as one `line` per row."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def is_command_line(line: ColumnOrName) -> Column:
    return col(line).rlike(fixed.COMMAND_LOG_PATTERN) | col(line).contains(fixed.SLOW_QUERY_MARK)


def _name_of(command: Column, line: Column) -> Column:
    """First key of a command document; else the first key-like token of the line."""
    named = F.filter(F.transform(F.json_object_keys(command), F.trim), lambda k: (k != "") & ~k.isin("$db", "lsid") & ~k.startswith("$"))
    token = F.regexp_extract(line, fixed.LOG_NAME_PATTERN, 1)
    return F.coalesce(F.get(named, F.lit(0)), F.nullif(token, F.lit("")), F.lit("unknown"))


def log_command_name(line: ColumnOrName) -> Column:
    """First key of the logged command; else the first key-like token."""
    return _name_of(F.get_json_object(col(line), "$.attr.command"), col(line))


def log_usage(lines: DataFrame, databases: list[str] | None = None) -> DataFrame:
    """One usage row per logged command; lines are not grouped.

    A line is parsed once, and its `attr` once. Without a list, all databases
    but the system ones are taken.
    """
    wanted = lines.filter(is_command_line("line"))
    opened = wanted.select("line", F.from_json("line", "t STRUCT<`$date`: STRING>, attr STRING").alias("l"))
    attr = F.from_json("l.attr", "ns STRING, command STRING").alias("a")
    parsed = opened.filter(F.col("l.attr").isNotNull()).select("line", blank("l.t.`$date`").alias("seen"), "l.attr", attr)
    parsed = parsed.filter(F.coalesce(F.col("a.ns"), F.lit("")).contains(".")).select("line", "seen", F.col("a.ns").alias("ns"), F.col("a.command").alias("command"))
    placed = parsed.withColumn("_place", namespace_parts("ns")).filter(F.col("_place.db_name") != "")
    owner = F.col("_place.db_name")
    kept = placed.filter(owner.isin(*databases) if databases else ~is_system_database(owner))
    name = _name_of(F.col("command"), F.col("line"))
    return kept.select(
        F.lit("command").alias("feature_type"),
        name.alias("feature_name"),
        name.alias("command_name"),
        F.lit("command").alias("op_type"),
        owner.alias("database"),
        F.col("_place.collection_name").alias("collection"),
        F.lit(1).cast("bigint").alias("usage_count"),
        F.col("seen").alias("first_seen"),
        F.col("seen").alias("last_seen"),
        F.lit(None).cast("bigint").alias("max_duration_ms"),
        F.lit("log.command").alias("sample_path"),
        F.col("line").alias("sample_value"),
    )


def log_counters(lines: DataFrame, databases: list[str]) -> DataFrame:
    """Lines read, and candidate lines that mention each database.

    Candidates are counted before their JSON is checked.
    """
    mentions = F.filter(F.lit(databases), lambda d: F.col("line").contains(d))
    candidates = F.when(is_command_line("line"), mentions).otherwise(F.array().cast("array<string>"))
    # Every line counts once under no name, and once for each database it mentions.
    each = lines.select(F.explode(F.concat(F.array(F.lit("")), candidates)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counts = each.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("n"))
    of = lambda name: F.coalesce(F.element_at("n", name), F.lit(0).cast("bigint"))
    rows = F.transform(
        F.lit(databases),
        lambda d: F.struct(d.alias("database"), of(F.lit("")).alias("log_scanned_line_count"), of(d).alias("log_matched_line_count")),
    )
    return counts.select(F.inline(rows))
