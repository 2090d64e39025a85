"""Summaries of usage, support and assessment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from portlens import fixed
from portlens.functions.support import effective_support, version_rank, versions_in
from portlens.functions.text import blank, clean_text, share
from portlens.operators.assess import complexity_rank, is_hotspot, priority_rank



def _stacked(frame: DataFrame, metrics: list[tuple[str, str, Column | None, str]]) -> DataFrame:
    """Several labelled counts stacked in one table, from one pass.

    Each metric is (name, column, condition, basis); its percentages are
    shares of the metric's own rows or of its own usage.
    """
    cells = [
        F.when(F.lit(True) if condition is None else condition, F.struct(F.lit(name).alias("metric"), F.col(column).alias("label")))
        for name, column, condition, _ in metrics
    ]
    counted = (
        frame.select("usage_count", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("m"))
        .groupBy("m.metric", "m.label")
        .agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("usage_count"))
    )
    whole = Window.partitionBy("metric")
    by_usage = [name for name, _, _, basis in metrics if basis == "usage"]
    part = F.when(F.col("metric").isin(*by_usage), F.col("usage_count")).otherwise(F.col("count"))
    return counted.withColumn("percentage", share(part, F.sum(part).over(whole)))


def usage_summary(mapped: DataFrame) -> DataFrame:
    return _stacked(
        mapped,
        [
            ("target_support_status", "target_support_status", None, "rows"),
            ("feature_type", "feature_type", None, "usage"),
            ("command_name", "command_name", None, "usage"),
        ],
    )


def migration_summary(assessed: DataFrame) -> DataFrame:
    in_scope = F.col("effective_scope") == "application_api"
    return _stacked(
        assessed,
        [
            ("effective_complexity", "effective_complexity", None, "rows"),
            ("effective_scope", "effective_scope", None, "rows"),
            ("effective_migration_necessity", "effective_migration_necessity", None, "rows"),
            ("migration_priority", "migration_priority", in_scope, "usage"),
            ("target_support_status", "target_support_status", in_scope, "rows"),
        ],
    )


def value_counts(frame: DataFrame, column: str, label: str = "label", blank_label: str = "Unknown") -> DataFrame:
    """Rows and share per value; NULL is counted under `blank_label`."""
    counted = frame.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(blank_label)).alias(label)).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("total")).scalar()
    return counted.select(label, "count", share(F.col("count"), total).alias("percentage"))


def labelled_counts(frame: DataFrame, column: str, fallback_label: str) -> DataFrame:
    """As `value_counts`, with blank text under the fallback label too."""
    label = F.coalesce(F.nullif(F.trim(blank(column)), F.lit("")), F.lit(fallback_label))
    return value_counts(frame.select(label.alias("_value")), "_value")


def top_values(frame: DataFrame, column: str, limit: int = 20, label: str = "label") -> DataFrame:
    """The most frequent values, with shares of the listed rows only."""
    counted = frame.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias(label)).agg(F.count(F.lit(1)).alias("count"))
    top = counted.orderBy(F.desc("count"), F.asc(label)).limit(limit)
    listed = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("percentage", share(F.col("count"), listed))


def support_summary(support: DataFrame) -> DataFrame:
    """Counts by status, by the most frequent support cells and by section."""

    def part(metric: str, counts: DataFrame) -> DataFrame:
        return counts.select(F.lit(metric).alias("metric"), F.col("label").alias("normalized_status"), "count", "percentage")

    return (
        part("normalized_status", value_counts(support, "normalized_status"))
        .unionByName(part("support_value_top20", top_values(support, "support_since")))
        .unionByName(part("section_count", value_counts(support, "section", blank_label="Unknown Section")))
    )


def scenario_matrix(support: DataFrame) -> DataFrame:
    """Support counts for every default version and mode, and the gain over the first version.

    Equal support cells are counted first, so each cell text is judged once
    per scenario.
    """
    first = fixed.DEFAULT_VERSIONS[0]
    scenarios = F.array(
        *[F.struct(F.lit(m).alias("mode"), F.lit(v).alias("version")) for m in fixed.MODES for v in fixed.DEFAULT_VERSIONS]
    )
    texts = support.groupBy(blank("support_since").alias("since")).agg(F.count(F.lit(1)).alias("n"))
    judged = texts.select("since", "n", F.inline(scenarios)).withColumn("status", effective_support("since", F.col("version"), F.col("mode")))
    counts = {
        "supported_count": "Supported",
        "partially_supported_count": "Partially Supported",
        "not_supported_count": "Not Supported",
        "unknown_count": "Unknown",
    }
    matrix = judged.groupBy("mode", "version").agg(
        F.sum("n").alias("total_feature_count"),
        *[F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0)).alias(name) for name, status in counts.items()],
    )
    base = F.max(F.when(F.col("version") == first, F.col("supported_count"))).over(Window.partitionBy("mode"))
    matrix = matrix.withColumns(
        {
            "supported_percentage": share(F.col("supported_count"), F.col("total_feature_count")),
            "baseline_supported_count": base,
            "delta_count": F.col("supported_count") - F.coalesce(base, F.lit(0)),
        }
    )
    return matrix.withColumns(
        {
            "point_label": F.format_string("%d / %.1f%%", "supported_count", "supported_percentage"),
            "delta_label": F.when(F.col("version") == fixed.DEFAULT_VERSIONS[-1], F.format_string("%+d", "delta_count")).otherwise(""),
        }
    )


def _api_key(columns: list[str]) -> list[Column]:
    """What makes two rows the same API."""
    scopes = [F.nullif(F.trim(blank(c)), F.lit("")) for c in ("target_section", "target_category") if c in columns]
    fields = [blank(c).alias(f"_{c}") for c in ("feature_type", "feature_name", "target_support_since") if c in columns]
    return [*fields, F.coalesce(*scopes, F.lit("")).alias("_scope")]


def _api_cards(frame: DataFrame, flags: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct APIs with each flag, from one grouped pass: an API has a flag that any of its rows has. `sums` counts rows."""
    by_api = frame.groupBy(*_api_key(frame.columns)).agg(
        F.lit(True).alias("api_count"),
        *[F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()],
        *[F.count_if(condition).alias(name) for name, condition in (sums or {}).items()],
    )
    counts = [F.count_if(F.col(name)).alias(name) for name in ("api_count", *flags)]
    return by_api.agg(*counts, *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in sums or {}])


def usage_cards(assessed: DataFrame) -> DataFrame:
    """Distinct APIs used: all, by status, hard ones and hotspots."""
    status = F.col("target_support_status")
    return _api_cards(
        assessed,
        {
            "supported_count": status == "Supported",
            "not_supported_count": status == "Not Supported",
            "high_complexity_count": F.col("effective_complexity").isin("High", "Blocker"),
            "hotspot_count": is_hotspot(),
            "report_hotspot_count": is_hotspot(require_scope=False),
        },
    )


def baseline_cards(baseline: DataFrame) -> DataFrame:
    """Distinct baseline APIs: all, matched, uncovered, hard, observed, unsupported."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in baseline.columns else F.lit(False)

    described = blank("source_short_description") if "source_short_description" in baseline.columns else F.lit("")
    return _api_cards(
        baseline,
        {
            "matched_count": flag("target_matched"),
            "uncovered_count": ~flag("target_matched"),
            "high_complexity_count": F.col("effective_complexity").isin("High", "Blocker"),
            "observed_count": flag("observed_in_profile"),
            "not_supported_count": F.col("target_support_statuses").contains("Not Supported"),
        },
        {"described_count": F.trim(described) != ""},
    )


def support_cards(support: DataFrame) -> DataFrame:
    return support.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("section").alias("section_count"),
        F.count_if(F.trim(blank("source_short_description")) != "").alias("described_count"),
    )


def sorted_list(column: str) -> Column:
    """Sorted distinct non-blank values as one comma list."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(blank(column)) != "", F.col(column).cast("string")))), ", ")


def api_baseline(assessed: DataFrame) -> DataFrame:
    """One row per API with everything the override editor shows.

    "First" values follow the assessed order.
    """
    firsts = (
        "default_scope",
        "effective_scope",
        "default_migration_necessity",
        "effective_migration_necessity",
        "migration_necessity_reason",
        "default_complexity",
        "effective_complexity",
        "recommended_action",
        "complexity_reason",
        "complexity_explanation",
    )
    order = F.struct(
        -complexity_rank(), -priority_rank(), -F.coalesce("usage_count", F.lit(0)), "feature_type", "feature_name", "command_name", "op_type", "database", "collection"
    )
    grouped = assessed.groupBy("feature_type", "feature_name", F.col("target_category").alias("target_section"), "target_support_since").agg(
        sorted_list("command_name").alias("command_contexts"),
        F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("usage_count"),
        sorted_list("collection").alias("collections"),
        F.count_distinct(F.when(F.trim(blank("database")) != "", F.col("database"))).alias("database_count"),
        F.min_by(F.struct(*firsts), order).alias("_first"),
        F.bool_or("override_applied").alias("override_applied"),
        sorted_list("target_support_status").alias("target_support_statuses"),
    )
    blanks = [F.lit("").alias(c) for c in ("override_scope", "override_complexity", "override_action", "override_reason")]
    return grouped.select("*", "_first.*", *blanks, F.lit(False).alias("override_enabled")).drop("_first")


def api_baseline_order() -> list[Column]:
    return [F.desc("usage_count"), F.asc("feature_type"), F.asc("feature_name"), F.asc("target_section")]


def database_summary(assessed: DataFrame, inventory: DataFrame | None = None, top: int = 3) -> DataFrame:
    """One row per database, from one pass over the rows; `inventory` adds its columns by `database`.

    Every row counts for its database and for its feature, command and collection
    there; ranks of the names, by rows and then by name, give the top lists.
    """
    owned = assessed.filter(blank("database") != fixed.INSTANCE_LEVEL)
    cell = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
    named = F.filter(F.array(cell("api", "feature_name"), cell("command", "command_name"), cell("collection", "collection")), lambda c: F.trim(blank(c["value"])) != "")
    own = F.array(F.struct(F.lit("row").alias("kind"), F.lit(None).cast("string").alias("value")))
    facts = {
        "total_usage_count": F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint"),
        "not_supported_count": F.count_if(F.col("target_support_status") == "Not Supported"),
        "high_complexity_count": F.count_if(F.col("effective_complexity") == "High"),
    }
    counted = (
        owned.select("database", "usage_count", "target_support_status", "effective_complexity", F.inline(F.concat(own, named)))
        .groupBy("database", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"), *[fact.alias(name) for name, fact in facts.items()])
    )
    rank = F.row_number().over(Window.partitionBy("database", "kind").orderBy(F.desc("n"), F.asc("value")))
    ranked = counted.withColumn("rank", rank)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)

    def names(kind: str) -> Column:
        listed = F.collect_list(of(kind, F.when(F.col("rank") <= top, F.struct("rank", "value"))))
        return F.array_join(F.transform(F.array_sort(listed), lambda x: x["value"]), ", ")

    grouped = ranked.groupBy("database").agg(
        F.coalesce(F.max(of("api", F.col("rank"))), F.lit(0)).cast("bigint").alias("unique_api_count"),
        *[F.max(of("row", F.col(name))).alias(name) for name in facts],
        names("command").alias("top_commands"),
        names("collection").alias("top_collections"),
    )
    return grouped if inventory is None else grouped.join(inventory, "database", "left")


def database_summary_order() -> list[Column]:
    return [F.desc("not_supported_count"), F.desc("high_complexity_count"), F.desc("unique_api_count"), F.asc("database")]


def available_versions(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Versions named anywhere in the columns, lowest first; defaults where none is named."""
    named = F.array_distinct(F.flatten(F.array(*[versions_in(c) for c in columns])))
    found = frame.select(F.explode(named).alias("version")).distinct()
    # One row whatever the table holds: its number of versions.
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    defaults = none.select(F.explode(F.lit(list(fixed.DEFAULT_VERSIONS))).alias("version"))
    return found.unionByName(defaults).withColumn("version_rank", version_rank(F.col("version")))


def facet_options(frame: DataFrame, columns: list[str], split: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values per column; columns in `split` hold comma lists."""

    def cells_of(column: str) -> Column:
        values = F.split(blank(column), ",") if column in split else F.array(blank(column))
        return F.transform(values, lambda v: F.struct(F.lit(column).alias("facet"), F.trim(v).alias("value")))

    cells = [cells_of(column) for column in columns]
    return frame.select(F.inline(F.flatten(F.array(*cells)))).filter(F.col("value") != "").distinct()


def merged_options(usage: DataFrame, baseline: DataFrame) -> DataFrame:
    """Options of the usage filters; statuses and necessities also take in what the baseline has.

    The usage table's own blanks are options, as the view lists them; blanks of
    comma lists, and of necessities, are none.
    """
    own = ["target_support_status", "op_type", "feature_type", "command_name", "effective_complexity"]
    scope = next((c for c in ("effective_migration_necessity", "effective_scope") if c in usage.columns), None)
    cells = [F.struct(F.lit(c).alias("facet"), blank(c).alias("value")) for c in own if c in usage.columns]
    cells += [F.struct(F.lit("scope").alias("facet"), blank(scope).alias("value"))] if scope else []
    listed = F.transform(F.split(blank("target_support_statuses"), ","), lambda v: F.struct(F.lit("target_support_status").alias("facet"), F.trim(v).alias("value")))
    other = next((c for c in ("effective_migration_necessity", "effective_scope") if c in baseline.columns), None)
    more = F.concat(listed, F.array(F.struct(F.lit("scope").alias("facet"), blank(other).alias("value")))) if other else listed
    options = usage.select(F.inline(F.array(*cells))).filter((F.col("facet") != "scope") | (F.col("value") != ""))
    return options.unionByName(baseline.select(F.inline(more)).filter("value != ''")).distinct()


def status_segments(support: DataFrame) -> DataFrame:
    """Rows per section and status; statuses outside the fixed order are Other."""
    known = ("Supported", "Not Supported", "Partially Supported")
    status = F.when(F.col("normalized_status").isin(*known), F.col("normalized_status")).otherwise("Other")
    counts = [F.count_if(status == s).alias(s.lower().replace(" ", "_")) for s in (*known, "Other")]
    return support.groupBy(F.coalesce("section", F.lit("Unknown Section")).alias("section")).agg(*counts)


def observed_rollup(usage: DataFrame, fold_expression: bool = False) -> DataFrame:
    """Observed use per feature; `fold_expression` counts expressions as operators."""
    kind = F.col("feature_type")
    if fold_expression:
        kind = F.when(kind == "expression", "operator").otherwise(kind)
    return usage.groupBy(kind.alias("feature_type"), "feature_name").agg(
        F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("observed_usage_count"),
        sorted_list("command_name").alias("observed_command_contexts"),
    )


def unknown_command_events(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("command_name") == "unknown").alias("unknown_command_event_count")
    )


def run_metadata(per_database: DataFrame) -> DataFrame:
    """One row for a run from one row per analysed database."""
    return per_database.agg(
        F.count(F.lit(1)).alias("database_count"),
        F.max("fetched_at").alias("fetched_at"),
        F.coalesce(F.sum("profile_count"), F.lit(0)).cast("bigint").alias("profile_count"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        F.coalesce(F.sum("log_scanned_line_count"), F.lit(0)).cast("bigint").alias("log_scanned_line_count"),
        F.coalesce(F.sum("log_matched_line_count"), F.lit(0)).cast("bigint").alias("log_matched_line_count"),
        F.coalesce(F.sum("metrics_filtered_row_count"), F.lit(0)).cast("bigint").alias("metrics_filtered_row_count"),
        sorted_list("effective_source").alias("effective_source"),
    )


def non_empty_columns(frame: DataFrame) -> list[str]:
    """Columns with any non-blank value, from one pass over the data."""
    flags = [F.bool_or(F.trim(blank(f"`{c}`")) != "").alias(f"c{i}") for i, c in enumerate(frame.columns)]
    row = frame.agg(*flags).first()
    return [c for i, c in enumerate(frame.columns) if row[i]]


def drop_empty_columns(frame: DataFrame) -> DataFrame:
    return frame.select(*[f"`{c}`" for c in non_empty_columns(frame)])


def drop_empty_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with any non-blank value; the text columns come back clean, without NULL."""
    texts = {c: clean_text(c) for c in columns}
    return frame.withColumns(texts).filter(F.concat(*[F.col(c) for c in columns]) != "")
