"""From workload evidence to an assessed usage table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F

from portlens.operators.assess import ASSESSMENT_COLUMNS, Platforms, assess, excluded, hotspot_order, hotspots
from portlens.operators.events import normalize_events
from portlens.operators.reports import api_baseline, migration_summary, usage_summary
from portlens.operators.support import map_support, retarget
from portlens.operators.usage import as_evidence, features, usage_counts, usage_rollup
from portlens.session import durable
from portlens.sources.counters import counter_usage, noise_count
from portlens.sources.evidence import first_present
from portlens.sources.logs import is_command_line, log_usage
from portlens.sources.profile import database_totals, newest, scan_profile


@dataclass(frozen=True)
class Analysis:
    """All tables of one analysis; `detail` is stored, the rest derive from it."""

    strategy: str
    detail: DataFrame
    summary: DataFrame
    migration_summary: DataFrame
    baseline: DataFrame
    hotspots: DataFrame
    excluded: DataFrame
    # With a cap only: records used of each database, and whether it left some out.
    totals: DataFrame | None = None
    # One row on what the run read, counted while it was read.
    metadata: DataFrame | None = None


def profile_usage(
    profile: DataFrame,
    databases: list[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
    legacy_detection: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Usage table of profiler records: of all, or with `limit` of the newest in each database.

    `seen` gets the number of records used and their newest time from the roll-up itself.
    """
    records = scan_profile(profile, databases, start, end)
    if limit is not None:
        records = newest(records, limit)
    if seen is not None:
        counted = [F.count(F.lit(1)).alias("profile_count"), F.max("ts").cast("string").alias("fetched_at")]
        return usage_rollup(normalize_events(records, legacy_detection), normalize_events(records.observe(seen, *counted), legacy_detection))
    return usage_rollup(normalize_events(records, legacy_detection))


def log_rows(lines: DataFrame, databases: list[str] | None, seen: Observation) -> DataFrame:
    """Usage rows of log lines; `seen` gets the lines read and the candidates among them."""
    counted = lines.observe(seen, F.count(F.lit(1)).alias("log_scanned_line_count"), F.count_if(is_command_line("line")).alias("log_matched_line_count"))
    return as_evidence(log_usage(counted, databases), "log")


def counter_rows(counters: DataFrame, filter_noise: bool, seen: Observation) -> DataFrame:
    """Usage rows of counter documents; `seen` gets the entries that the noise filter drops.

    The documents are read for commands, stages and operators; one of these reads is counted.
    """
    dropped = F.sum(noise_count("metrics")) if filter_noise else F.lit(0).cast("bigint")
    counted = counters.observe(seen, F.coalesce(dropped, F.lit(0)).cast("bigint").alias("metrics_filtered_row_count"))
    return as_evidence(counter_usage(counters, filter_noise, counted), "counters")


_METADATA = "effective_source STRING, fetched_at STRING, profile_count LONG, truncated BOOLEAN, log_scanned_line_count LONG, log_matched_line_count LONG, metrics_filtered_row_count LONG, usage_row_count LONG"


def _metadata(detail: DataFrame, strategy: str, seen: dict[str, object], truncated: bool) -> DataFrame:
    names = ("log_scanned_line_count", "log_matched_line_count", "metrics_filtered_row_count")
    row = (strategy, str(seen.get("fetched_at") or ""), int(seen.get("profile_count") or 0), truncated, *[int(seen.get(n) or 0) for n in names], detail.count())
    return detail.sparkSession.createDataFrame([row], _METADATA)


def report(assessed: DataFrame, strategy: str = "PROFILE_ONLY") -> Analysis:
    return Analysis(
        strategy=strategy,
        detail=assessed,
        summary=usage_summary(assessed),
        migration_summary=migration_summary(assessed),
        baseline=api_baseline(assessed),
        hotspots=hotspots(assessed),
        excluded=excluded(assessed),
    )


def analyze(
    support: DataFrame,
    rules: DataFrame,
    overrides: DataFrame | None = None,
    profile: DataFrame | None = None,
    log_lines: DataFrame | None = None,
    counters: DataFrame | None = None,
    strategy: str = "AUTO",
    databases: list[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
    legacy_detection: bool = False,
    filter_noise: bool = False,
    rules_version: str = "",
    platforms: Platforms = Platforms(),
) -> Analysis:
    """Pick the best evidence, match it with the support table and assess it.

    The time window and the reading of commands hold for profiler records. All
    records count; a `limit` takes the newest of each database, and `totals` then
    says which databases it cut.
    """
    probes, build = {}, {}
    seen = Observation()
    if profile is not None:
        probes["PROFILE_ONLY"] = features(normalize_events(scan_profile(profile, databases, start, end), legacy_detection))
        build["PROFILE_ONLY"] = lambda: as_evidence(profile_usage(profile, databases, start, end, limit, legacy_detection, seen), "profile")
    if log_lines is not None:
        probes["LOG_ONLY"] = log_usage(log_lines, databases)
        build["LOG_ONLY"] = lambda: log_rows(log_lines, databases, seen)
    if counters is not None:
        probes["METRICS_ONLY"] = counter_usage(counters, filter_noise)
        build["METRICS_ONLY"] = lambda: counter_rows(counters, filter_noise, seen)
    resolved = first_present(probes, strategy)
    assessed = assess(map_support(build[resolved](), support), rules, overrides, rules_version, platforms)
    found = report(durable(assessed), resolved)
    totals = None
    if limit is not None and resolved == "PROFILE_ONLY":
        totals = durable(database_totals(scan_profile(profile, databases, start, end), limit))
    cut = totals is not None and not totals.filter("truncated").isEmpty()
    return replace(found, totals=totals, metadata=_metadata(found.detail, resolved, seen.get, cut))


def reassess(
    detail: DataFrame,
    rules: DataFrame,
    overrides: DataFrame | None,
    version: str,
    mode: str,
    rules_version: str = "",
    platforms: Platforms = Platforms(),
) -> Analysis:
    """The same usage for another target version and mode."""
    usage = detail.drop(*ASSESSMENT_COLUMNS)
    return report(assess(retarget(usage, version, mode), rules, overrides, rules_version, platforms))


def worst_first(profile: DataFrame, support: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Hotspots of the whole workload, worst first.

    Answers which features in use the target does not support, from all
    records and without samples: one pass over the profile.
    """
    counts = usage_counts(normalize_events(scan_profile(profile)))
    assessed = assess(map_support(counts, support), rules, overrides)
    columns = [
        "feature_type",
        "feature_name",
        "command_name",
        "op_type",
        "database",
        "collection",
        "usage_count",
        "max_duration_ms",
        "target_support_status",
        "target_support_since",
        "effective_complexity",
        "migration_priority",
        "recommended_action",
    ]
    return hotspots(assessed).orderBy(*hotspot_order()).select(*columns)
