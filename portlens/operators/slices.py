"""Filters and drill-downs over the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.text import blank
from portlens.operators.assess import complexity_rank, priority_rank
from portlens.operators.usage import USAGE_KEYS

_SUPPORT_SEARCH = ("command", "operator", "stage", "source_short_description", "source_doc_url")
_USAGE_SEARCH = (
    "database",
    "feature_name",
    "collection",
    "op_type",
    "command_name",
    "target_category",
    "target_support_since",
    "target_support_status",
    "effective_complexity",
    "effective_migration_necessity",
    "recommended_action",
)
_BASELINE_SEARCH = (
    "feature_name",
    "feature_type",
    "target_section",
    "target_support_since",
    "target_support_statuses",
    "source_short_description",
    "source_group",
    "baseline_source_kind",
    "target_uncovered_reason",
    "effective_complexity",
    "effective_migration_necessity",
    "complexity_explanation",
    "observed_command_contexts",
)
RISK_STATUSES = ("Partially Supported", "Not Supported", "Unknown")


def mentions(frame: DataFrame, keyword: str, columns: Sequence[str], joined: bool = False) -> Column:
    """The keyword occurs literally, whatever its case.

    `joined` searches the columns as one text, as the report view does.
    """
    word = keyword.strip().lower()
    present = [c for c in columns if c in frame.columns]
    if not word or not present:
        return F.lit(True)
    if joined:
        return F.lower(F.concat_ws(" ", *[blank(c) for c in present])).contains(word)
    found = F.lit(False)
    for c in present:
        found = found | F.lower(blank(c)).contains(word)
    return found


def any_of(frame: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Membership; an empty selection or a missing column lets all through."""
    return F.col(column).isin(*values) if values and column in frame.columns else F.lit(True)


def _items(*columns: str) -> Column:
    return F.transform(F.split(F.concat_ws(",", *[blank(c) for c in columns]), ","), F.trim)


def _necessity(frame: DataFrame) -> str:
    return "effective_migration_necessity" if "effective_migration_necessity" in frame.columns else "effective_scope"


def filter_support(
    support: DataFrame,
    keyword: str = "",
    sections: Sequence[str] = (),
    statuses: Sequence[str] = (),
    report_search: bool = False,
    described_only: bool = False,
) -> DataFrame:
    kept = support.filter(any_of(support, "section", sections) & any_of(support, "normalized_status", statuses))
    if described_only:
        kept = kept.filter(F.trim(blank("source_short_description")) != "")
    return kept.filter(mentions(support, keyword, _SUPPORT_SEARCH, report_search))


def filter_usage(
    assessed: DataFrame,
    databases: Sequence[str] = (),
    statuses: Sequence[str] = (),
    op_types: Sequence[str] = (),
    feature_types: Sequence[str] = (),
    commands: Sequence[str] = (),
    complexities: Sequence[str] = (),
    necessities: Sequence[str] = (),
    keyword: str = "",
) -> DataFrame:
    facets = {
        "database": databases,
        "target_support_status": statuses,
        "op_type": op_types,
        "feature_type": feature_types,
        "command_name": commands,
        "effective_complexity": complexities,
        _necessity(assessed): necessities,
    }
    kept = assessed
    for column, values in facets.items():
        kept = kept.filter(any_of(assessed, column, values))
    return kept.filter(mentions(assessed, keyword, _USAGE_SEARCH))


def filter_baseline(
    baseline: DataFrame,
    statuses: Sequence[str] = (),
    feature_types: Sequence[str] = (),
    commands: Sequence[str] = (),
    complexities: Sequence[str] = (),
    necessities: Sequence[str] = (),
    keyword: str = "",
    only_observed: bool = False,
) -> DataFrame:
    """Statuses and commands match when they overlap a row's comma lists."""
    kept = baseline
    if only_observed and "observed_in_profile" in baseline.columns:
        kept = kept.filter(F.coalesce("observed_in_profile", F.lit(False)))
    for column, values in (
        ("feature_type", feature_types),
        ("effective_complexity", complexities),
        (_necessity(baseline), necessities),
    ):
        kept = kept.filter(any_of(baseline, column, values))
    if statuses and "target_support_statuses" in baseline.columns:
        kept = kept.filter(F.arrays_overlap(_items("target_support_statuses"), F.lit(list(statuses))))
    if commands:
        columns = [c for c in ("feature_name", "observed_command_contexts") if c in baseline.columns]
        kept = kept.filter(F.arrays_overlap(_items(*columns), F.lit(list(commands))))
    return kept.filter(mentions(baseline, keyword, _BASELINE_SEARCH))


def risks(assessed: DataFrame, **facets: Sequence[str]) -> DataFrame:
    """Features that are not fully supported, within the chosen facets."""
    return filter_usage(assessed.filter(F.col("target_support_status").isin(*RISK_STATUSES)), **facets)


def risk_order() -> list[Column]:
    return [priority_rank().desc(), complexity_rank().desc(), F.desc("usage_count"), F.asc("feature_type"), F.asc("feature_name")]


def database_level(usage: DataFrame) -> DataFrame:
    return usage.filter(blank("database") != fixed.INSTANCE_LEVEL)


def instance_level(usage: DataFrame) -> DataFrame:
    return usage.filter(blank("database") == fixed.INSTANCE_LEVEL)


def evidence(assessed: DataFrame, **selected: str | None) -> DataFrame:
    """The most used row with exactly the selected key values (NULL included)."""
    kept = assessed
    for column, value in selected.items():
        kept = kept.filter(F.col(column).eqNullSafe(F.lit(value)))
    return kept.orderBy(F.desc("usage_count"), *[c for c in USAGE_KEYS if c in assessed.columns]).limit(1)
