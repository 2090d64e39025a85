from __future__ import annotations

import pytest

from portlens.operators.assess import Platforms, assess, assessed_order, excluded_order, hotspot_order, hotspots, run_quality
from portlens.plans.usage_analysis import reassess
from portlens.sources.rules import OVERRIDE_COLUMNS, built_in_rules, normalize_overrides, small_table

USAGE = (
    "feature_type STRING, feature_name STRING, command_name STRING, op_type STRING, database STRING, collection STRING, usage_count LONG, "
    "max_duration_ms LONG, target_support_status STRING, target_support_since STRING, target_category STRING, target_feature STRING"
)


def used(kind, name, status="Unknown", count=1, ms=None, since=""):
    return (kind, name, "x", "command", "app", "c", count, ms, status, since, "S", name)


def assessed(spark, rows, overrides=(), **options):
    table = normalize_overrides(small_table(spark, OVERRIDE_COLUMNS, list(overrides)))
    return assess(spark.createDataFrame(rows, USAGE), built_in_rules(spark), table, "v", **options)


@pytest.mark.parametrize(
    "row, complexity, priority",
    [
        (used("command", "find", "Supported"), "Low", "Low"),
        (used("command", "find", "Supported", 50), "Low", "Medium"),
        (used("command", "find", "Not Supported"), "High", "High"),
        (used("command", "find", "Not Supported", 10), "High", "Critical"),
        (used("command", "find", "Partially Supported", 1, 1000), "Medium", "High"),
        (used("command", "find", "Other"), "Low", "Low"),
        (used("stage", "$group", "Supported"), "Low", "Low"),
        (used("stage", "$group", "Unknown"), "High", "High"),
        (used("stage", "$graphLookup", "Not Supported"), "Blocker", "Critical"),
        (used("stage", "$GraphLookup ", None), "Blocker", "Critical"),
        (used("command", "ping", "Not Supported", 500), "Ignore", "Low"),
        (used("stage", "$neverHeardOf", "Not Supported"), "High", "High"),
    ],
)
def test_complexity_and_priority(spark, row, complexity, priority):
    result = assessed(spark, [row]).first()
    assert (result.effective_complexity, result.migration_priority) == (complexity, priority)


def test_scope_override_keeps_complexity(spark):
    result = assessed(spark, [used("command", "listIndexes", "Not Supported")], [("command", "LISTINDEXES", "application_api", "", "", "", "true")]).first()
    assert (result.effective_scope, result.effective_complexity, result.effective_migration_necessity) == ("application_api", "Ignore", "Required")
    assert result.default_migration_necessity == "Conditional"


def test_last_override_wins_and_disabled_ones_do_not_count(spark):
    overrides = [
        ("stage", "$group", "", "Low", "one", "", "true"),
        ("stage", "$group", "", "", "two", "verify_semantics", "yes"),
        ("stage", "$group", "", "Blocker", "three", "", "no"),
    ]
    result = assessed(spark, [used("stage", "$group", "Unknown")], overrides).first()
    assert (result.effective_complexity, result.complexity_reason, result.recommended_action) == ("High", "two", "verify_semantics")
    assert result.override_applied


def test_texts_name_the_platforms(spark):
    names = Platforms(source="SourceDB", target="TargetDB API", vendor="TargetDB")
    result = assessed(spark, [used("command", "fileMD5x", "Not Supported", 3), used("command", "convertToCapped")], platforms=names).collect()
    texts = {r.feature_name: r for r in result}
    assert "TargetDB API marks it as Not Supported" in texts["fileMD5x"].complexity_explanation
    assert texts["fileMD5x"].complexity_explanation.endswith("It is observed 3 time(s) in the current workload.")
    assert texts["fileMD5x"].complexity_adjustment_reason == "TargetDB support status is Not Supported."


def test_quality_counts_rows_not_rules(spark):
    rows = [used("stage", "$x"), used("stage", "$x"), used("command", "oddCommand"), used("stage", "$match")]
    quality = run_quality(assessed(spark, rows, [("stage", "$x", "", "", "why", "", "true")])).first()
    assert (quality.usage_row_count, quality.unclassified_feature_count, quality.override_count, quality.rules_coverage_rate) == (4, 2, 2, 0.5)


def test_orders(spark):
    rows = [
        used("stage", "$match", "Supported", 90),
        used("stage", "$group", "Unknown", 2, 5),
        used("stage", "$lookup", "Unknown", 30),
        used("stage", "$graphLookup", "Not Supported"),
        used("operator", "$odd", "Unknown", 25),
        used("stage", "$facet", "Unknown", 2, 9),
        used("command", "ping", "Unknown", 3),
        used("command", "hello", "Unknown", 3),
    ]
    frame = assessed(spark, rows)
    assert [r.feature_name for r in frame.orderBy(*assessed_order()).collect()] == ["$graphLookup", "$lookup", "$facet", "$group", "$odd", "$match", "hello", "ping"]
    assert [r.feature_name for r in hotspots(frame).orderBy(*hotspot_order()).collect()] == ["$graphLookup", "$lookup", "$facet", "$group", "$odd"]
    out = frame.filter("effective_scope = 'ignore'").orderBy(*excluded_order()).collect()
    assert [r.feature_name for r in out] == ["hello", "ping"]


def test_empty_usage_keeps_its_schema(spark):
    frame = assessed(spark, [])
    assert frame.count() == 0 and "review_priority" in frame.columns and "migration_priority" in frame.columns


def test_reassess_for_another_target(spark):
    first = assessed(spark, [used("stage", "$group", "Supported", since="26ai")])
    rules = built_in_rules(spark)
    old = reassess(first, rules, None, "19c", "op").detail.first()
    new = reassess(first, rules, None, "26ai", "op").detail.first()
    assert (old.target_support_status, old.effective_complexity) == ("Not Supported", "High")
    assert (new.target_support_status, new.effective_complexity) == ("Supported", "Low")
