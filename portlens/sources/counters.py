"""Server counters (one JSON document per instance) to usage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.text import ColumnOrName, col
from portlens.operators.walk import walk_sql


def _object(node: ColumnOrName) -> Column:
    return F.try_variant_get(col(node), "$", "map<string,variant>")


def _is_number(value: Column) -> Column:
    return F.schema_of_variant(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _whole(value: Column) -> Column:
    exact = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.coalesce(exact, F.try_variant_get(value, "$", "double").try_cast("bigint"))


def counter_value(value: ColumnOrName) -> Column:
    """Count held by a counter: a number, `total`, or the sum of its parts.

    Flags are no counts.
    """
    value = col(value)
    fields = _object(value)
    total = fields["total"]
    numbers = F.filter(F.map_values(fields), _is_number)
    parts = F.aggregate(F.transform(numbers, _whole), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return (
        F.when(_is_number(value), _whole(value))
        .when(F.coalesce(_is_number(total), F.lit(False)), _whole(total))
        .when(F.size(numbers) > 0, parts)
    )


def _rows(kind: Column, name: Column, command: Column, count: Column, path: Column, value: Column) -> list[Column]:
    return [
        kind.alias("feature_type"),
        name.alias("feature_name"),
        command.alias("command_name"),
        F.lit("command").alias("op_type"),
        F.lit(fixed.INSTANCE_LEVEL).alias("database"),
        F.lit("").alias("collection"),
        count.alias("usage_count"),
        F.lit("").alias("first_seen"),
        F.lit("").alias("last_seen"),
        F.lit(None).cast("bigint").alias("max_duration_ms"),
        path.alias("sample_path"),
        F.to_json(value).alias("sample_value"),
    ]


def is_noise(name: ColumnOrName) -> Column:
    return F.lower(F.trim(col(name))).isin(*fixed.NOISE_COMMANDS)


def noise_count(metrics: ColumnOrName) -> Column:
    """Number of a document's command counters that the noise filter drops."""
    names = F.json_object_keys(F.get_json_object(col(metrics), "$.commands"))
    return F.coalesce(F.size(F.filter(names, is_noise)), F.lit(0))


def _section(counters: DataFrame, name: str) -> DataFrame:
    return counters.select("instance", "metrics", F.try_variant_get(F.try_parse_json("metrics"), f"$.{name}", "variant").alias("tree"))


def command_counters(counters: DataFrame, filter_noise: bool = False) -> DataFrame:
    entries = _section(counters, "commands").select("instance", F.explode(_object(F.col("tree"))).alias("name", "value"))
    if filter_noise:
        entries = entries.filter(~is_noise("name"))
    counted = entries.withColumn("n", counter_value("value")).filter(F.col("n") > 0)
    name = F.col("name")
    return counted.select(
        "instance", *_rows(F.lit("command"), name, name, F.col("n"), F.concat(F.lit("metrics.commands."), name), F.col("value"))
    )


def dropped_commands(counters: DataFrame) -> DataFrame:
    """What the noise filter drops per instance: entries and sorted names."""
    names = _section(counters, "commands").select(
        "instance", F.array_sort(F.filter(F.map_keys(_object(F.col("tree"))), is_noise)).alias("dropped")
    )
    return names.select(
        "instance",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("filtered_row_count"),
        F.coalesce(F.array_join("dropped", ", "), F.lit("")).alias("dropped_command_names"),
    )


def _tree_counters(counters: DataFrame, section: str, kind: str, command: str) -> DataFrame:
    root = (
        f"array(named_struct('path', 'metrics.{section}', 'key', '', 'outer_expr', false, 'in_expr', false, 'node', tree))"
    )
    nodes = _section(counters, section).select("instance", F.explode(F.expr(walk_sql(root, "metrics", arrays=False))).alias("f"))
    counted = nodes.withColumn("n", counter_value("f.node")).filter(F.col("n") > 0)
    return counted.select(
        "instance",
        *_rows(F.lit(kind), F.col("f.key"), F.lit(command), F.col("n"), F.col("f.path"), F.col("f.node")),
    )


def stage_counters(counters: DataFrame) -> DataFrame:
    return _tree_counters(counters, "aggStageCounters", "stage", "aggregate")


def operator_counters(counters: DataFrame) -> DataFrame:
    return _tree_counters(counters, "operatorCounters", "operator", "unknown")


def counter_usage(counters: DataFrame, filter_noise: bool = False, observed: DataFrame | None = None) -> DataFrame:
    """Command, stage and operator rows. `observed` are the same documents, observed while their commands are read."""
    return (
        command_counters(counters if observed is None else observed, filter_noise)
        .unionByName(stage_counters(counters))
        .unionByName(operator_counters(counters))
    )
