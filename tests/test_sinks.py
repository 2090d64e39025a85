"""Replaced tables, landed records, rejected lines, ranks and report plans."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from portlens.cases.queries import Inputs
from portlens.operators import ranks, reports
from portlens.operators.assess import assessed_order
from portlens.plans.usage_analysis import analyze
from portlens.sources import profile as prof, snapshots, versions
from portlens.sources.evidence import first_present
from portlens.sources.pages import reference_rows, support_tables, tables_under_headings


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_readers_keep_their_version(spark, tmp_path):
    root = f"file://{tmp_path}/sink"
    first = versions.publish(root, {"t": spark.range(3), "u": spark.range(1)}, {"made": "once"})
    before = versions.published(spark, root, "t")
    assert versions.current(spark, root) == {"version": first, "rows": {"t": 3, "u": 1}, "info": {"made": "once"}}
    second = versions.publish(root, {"t": spark.range(5)})
    assert before.count() == 3 and versions.published(spark, root, "t").count() == 5 and first != second
    assert versions.published(spark, root, "t", first).count() == 3
    # A run that fails half-way leaves the current version alone.
    with pytest.raises(Exception):
        versions.publish(root, {"t": spark.range(2), "bad": spark.range(2).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert versions.current(spark, root)["version"] == second
    assert versions.current(spark, f"{root}/none") is None
    with pytest.raises(FileNotFoundError):
        versions.published(spark, f"{root}/none", "t")


def test_bad_overrides_are_not_published(spark, tmp_path):
    root = f"file://{tmp_path}/overrides"
    rows = spark.createDataFrame([("stage", "$x", "", "High", "r", "", "yes")], "feature_type STRING, feature_name STRING, override_scope STRING, override_complexity STRING, override_reason STRING, override_action STRING, enabled STRING")
    version = snapshots.publish_overrides(rows, root)
    with pytest.raises(ValueError, match="Awful"):
        snapshots.publish_overrides(rows.withColumn("override_complexity", F.lit("Awful")), root)
    assert versions.current(spark, root)["version"] == version
    assert versions.published(spark, root, "overrides").first().enabled == "true"


def test_only_folders_of_the_window_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/landed"
    i = Inputs(spark, DATA)
    prof.land_profile(prof.scan_profile(i.profile), root)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05T06:00:00", "2024-01-07T12:00:00"))
    kept = prof.read_landed(spark, root, ["app_1"], start, end)
    filters = plan(kept).split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "event_date" in filters and "db_name" in filters
    files = {r[0] for r in kept.select(F.input_file_name()).distinct().collect()}
    assert files and all("db_name=app_1" in f and any(f"event_date=2024-01-0{d}" in f for d in (5, 6, 7)) for f in files)
    wanted = prof.scan_profile(i.profile, ["app_1"], start, end)
    assert sorted(r.event_key for r in kept.collect()) == sorted(r.event_key for r in wanted.collect())
    # Few folders, named by a table, are the only ones read.
    keys = spark.createDataFrame([(dt.date(2024, 1, 9), "app_0")], "event_date date, db_name string")
    named = prof.landed_days(spark.read.parquet(root), keys.filter("event_date > DATE'2024-01-01'"))
    assert "dynamicpruning" in named._jdf.queryExecution().optimizedPlan().toString() and named.count() == spark.read.parquet(root).filter("event_date = '2024-01-09' AND db_name = 'app_0'").count()


def test_broken_lines_are_no_events(spark, tmp_path):
    lines = ['{"ns":"a.b","op":"query","millis":3}', '{"ns":"a.b","op":', "no json", "", '[{"ns":"a.c"}]', '{"ns":"a.d"} x', '{"ns":"a.e","command":{"find":"c","filter":{"$or":[]}},"ts":"2024-01-02T03:04:05"}']
    (tmp_path / "export.json").write_text("\n".join(lines))
    records = prof.read_profile(spark, f"file://{tmp_path}").orderBy("ns").collect()
    assert [r.ns for r in records] == ["a.b", "a.e"] and records[1].command == '{"find":"c","filter":{"$or":[]}}' and records[1].ts == dt.datetime(2024, 1, 2, 3, 4, 5)
    rejected = prof.rejected_lines(prof.read_lines(spark, f"file://{tmp_path}")).collect()
    assert sorted(r.line for r in rejected) == sorted(lines[k] for k in (1, 2, 4, 5)) and all(r.file.endswith("export.json") for r in rejected)


def test_ranks_need_no_single_task(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("y")).repartition(7)
    got = ranks.ranked(frame, [F.desc("x")])
    assert "SinglePartition" not in plan(got) and {(r.x, r["rank"]) for r in got.collect()} == {(x, 1000 - x) for x in range(1000)}
    assert ranks.ranked(frame.filter("x < 0"), [F.asc("x")]).count() == 0
    with pytest.raises(ValueError):
        ranks.ranked(frame, [F.asc("x")], "y")
    detail = Inputs(spark, DATA).detail
    ordered = detail.orderBy(*assessed_order()).collect()
    assert [r.feature_name for r in ranks.ranked(detail, assessed_order()).orderBy("rank").collect()] == [r.feature_name for r in ordered]


def test_cards_and_databases_take_one_pass(spark):
    detail = Inputs(spark, DATA).detail
    assert "Expand" not in plan(reports.usage_cards(detail))
    assert plan(reports.database_summary(detail)).count("Scan ExistingRDD") == 1
    assert reports.usage_cards(detail.limit(0)).first().api_count == 0


def test_metadata_is_counted_by_the_run(spark):
    i = Inputs(spark, DATA)
    told = analyze(i.support, i.rules, profile=i.profile, limit=20).metadata.first()
    records = prof.scan_profile(i.profile)
    assert told.truncated and told.profile_count == prof.newest(records, 20).count() and told.fetched_at.startswith("2024")
    assert not analyze(i.support, i.rules, profile=i.profile).metadata.first().truncated


def test_the_first_source_with_uses_is_taken(spark):
    some, none = spark.range(1), spark.range(0)
    assert first_present({"PROFILE_ONLY": none, "LOG_ONLY": some, "METRICS_ONLY": some}) == "LOG_ONLY"
    assert first_present({"PROFILE_ONLY": some, "METRICS_ONLY": some}, "METRICS_ONLY") == "METRICS_ONLY"
    with pytest.raises(ValueError, match="no source"):
        first_present({"PROFILE_ONLY": none})
    with pytest.raises(ValueError, match="unknown"):
        first_present({}, "ANY")


NESTED = """<h2>One</h2><TABLE a="1"><tr><th>Name</th><th>Description</th></tr><tr><td>x <table><tr><th>Name</th><th>Description</th></tr><tr><td>deep<table><tr><td>deepest</td></tr></table></td><td>inner</td></tr></table> y</td><td>outer</td></tr></table>
</table><p>stray end</p><h3>Two</h3><table><tr><th>Support</th></tr><tr><td>open"""


def test_nested_tables_are_kept_apart(spark):
    pages = spark.createDataFrame([(1, "http://h/p", "stage", "g", "l", NESTED)], "page_id LONG, url STRING, entity_type STRING, source_group STRING, source_label STRING, html STRING")
    found = pages.select(F.inline(tables_under_headings("html", 3))).collect()
    assert [r.heading for r in found] == ["One", "One", "One", "Two"]
    assert "deepest" in found[1].html and found[1].html.count("<table") == 1 and found[3].html.endswith("open")
    assert found[0].html.lower().count("<table") == 1 and "<th>" in found[0].html and found[2].html.startswith("<table><tr><td>deepest")
    rows = reference_rows(pages).orderBy("ordinal").collect()
    assert [(r.category, r.name, r.short_description) for r in rows] == [("One", "x Name Description deep deepest inner y", "outer"), ("One", "deep deepest", "inner")]
    assert support_tables(pages).count() == 0
