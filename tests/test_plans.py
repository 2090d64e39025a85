from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from portlens.cases.queries import Inputs
from portlens.operators.reports import drop_empty_columns, usage_summary
from portlens.operators.slices import evidence, filter_baseline, filter_usage
from portlens.operators.usage import usage_counts, usage_order
from portlens.plans.usage_analysis import analyze
from portlens.streaming.usage_stream import usage_stream


def test_analysis_from_profile(spark):
    i = Inputs(spark, DATA)
    result = analyze(i.support, i.rules, i.overrides, profile=i.profile, limit=None, rules_version="v1.1")
    assert result.strategy == "PROFILE_ONLY"
    assert result.detail.count() == i.counts.count()
    assert result.hotspots.count() and result.excluded.count() and result.baseline.count()
    detail = result.detail.filter("feature_name = '$match'").first()
    assert detail.sample_path.startswith("command.pipeline[") and json.loads(detail.sample_value)
    capped = analyze(i.support, i.rules, profile=i.profile, limit=10)
    uses = capped.detail.filter("feature_type = 'command'").groupBy("database").agg(F.sum("usage_count").alias("n"))
    assert max(r.n for r in uses.collect()) <= 10


def test_order_of_usage(spark):
    i = Inputs(spark, DATA)
    rows = i.counts.orderBy(*usage_order()).select("usage_count", "feature_type", "feature_name", "database", "collection", "op_type").collect()
    assert rows == sorted(rows, key=lambda r: (-r.usage_count, *r[1:]))


def test_summary_arithmetic(spark):
    """Counts 5, 110 and 40 of a known run give the known percentages."""
    rows = [("Supported", "command", "find", 28), ("Supported", "stage", "aggregate", 52), ("Unknown", "operator", "find", 30)]
    frame = spark.createDataFrame(rows, "target_support_status STRING, feature_type STRING, command_name STRING, usage_count LONG")
    got = {(r.metric, r.label): (r["count"], r.usage_count, r.percentage) for r in usage_summary(frame).collect()}
    assert got["target_support_status", "Supported"] == (2, 80, 66.67)
    assert got["feature_type", "stage"] == (1, 52, 47.27)
    assert got["command_name", "find"] == (2, 58, 52.73)


def test_filters_without_a_choice_keep_all(spark):
    i = Inputs(spark, DATA)
    assert filter_usage(i.detail).count() == i.detail.count()
    assert filter_usage(i.detail, keyword="NO SUCH TEXT").isEmpty()
    assert filter_baseline(i.baseline, keyword=" $MATCH ").count() >= 1


def test_evidence_is_null_safe(spark):
    frame = spark.createDataFrame([("a", None, 1), ("a", None, 5), ("a", "x", 9)], "feature_name STRING, op_type STRING, usage_count LONG").withColumn(
        "feature_type", F.lit("t")
    )
    assert evidence(frame, feature_name="a", op_type=None).first().usage_count == 5


def test_empty_columns(spark):
    frame = spark.createDataFrame([(" ", "a", None), (None, "", None)], "x STRING, y STRING, `z z` STRING")
    assert drop_empty_columns(frame).columns == ["y"]


def test_stream_equals_batch(spark, tmp_path):
    i = Inputs(spark, DATA)
    batch = usage_counts(i.events)
    source = str(tmp_path / "in")
    i.profile.write.parquet(source)
    schema = i.profile.schema
    late = spark.createDataFrame([(10**9, dt.datetime(2030, 1, 1), "zz.c", "command", '{"ping":1}')], "event_key LONG, ts TIMESTAMP_NTZ, ns STRING, op STRING, command STRING")
    late = late.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in late.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    late.write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    typed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    query = (
        usage_stream(typed).writeStream.format("memory").queryName("usage_stream_test").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    keys = ["feature_type", "feature_name", "command_name", "op_type", "database", "collection"]
    got = spark.table("usage_stream_test").groupBy(*keys).agg(F.sum("usage_count").alias("n"))
    want = batch.select(*keys, F.col("usage_count").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_cluster_needs_a_shared_folder(spark):
    from portlens.session import durable

    assert durable(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None


@pytest.mark.parametrize("name", ["usage_counts", "support_join", "assessment", "scenario_matrix"])
def test_plans_have_no_cross_join_or_single_task_sort(spark, name):
    from portlens.cases.queries import CASES

    plan = CASES[name][0](Inputs(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan
