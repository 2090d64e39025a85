from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portlens.functions.support import effective_support, raw_status, versions_in
from portlens.operators.support import map_support, status_column, support_as_usage

# Support cell, its own status, then 19c/op, 19c/no-op, 26ai/op.
CELLS = [
    ("19c", "Supported", "Supported", "Supported", "Supported"),
    ("26ai", "Supported", "Not Supported", "Not Supported", "Supported"),
    ("26ai. No-op (19c)", "Supported", "Not Supported", "Supported", "Supported"),
    ("No-op", "Supported", "Not Supported", "Supported", "Not Supported"),
    ("Not supported", "Not Supported", "Not Supported", "Not Supported", "Not Supported"),
    ("Always", "Supported", "Not Supported", "Not Supported", "Not Supported"),
    ("Partially supported 19c", "Partially Supported", "Supported", "Supported", "Supported"),
    ("", "Other", "Unknown", "Unknown", "Unknown"),
    (None, "Other", "Unknown", "Unknown", "Unknown"),
    ("4.2", "Supported", "Not Supported", "Not Supported", "Not Supported"),
    ("n/a", "Not Supported", "Not Supported", "Not Supported", "Not Supported"),
    ("26ai (19c)", "Supported", "Not Supported", "Not Supported", "Supported"),
]


def test_cells(spark):
    frame = spark.createDataFrame([(n, c[0]) for n, c in enumerate(CELLS)], "n INT, since STRING")
    scenarios = [("19c", "op"), ("19c", "no-op"), ("26ai", "op")]
    rows = frame.select("n", raw_status("since"), *[effective_support("since", v, m) for v, m in scenarios]).orderBy("n").collect()
    assert [tuple(r)[1:] for r in rows] == [c[1:] for c in CELLS]


@pytest.mark.parametrize(
    "since, version, mode, status",
    [
        ("26ai. No-op (19c)", "任意版本", "任意部署方式", "Supported"),
        ("No-op", "any", "any", "Supported"),
        ("No-op", "23ai", "no-op", "Not Supported"),
        ("19c", "", "op", "Supported"),
        ("26ai", "27 AI", "noop", "Supported"),
        ("26ai", "soon", "op", "Not Supported"),
        ("No-op (19c)", "26ai", "no_op", "Not Supported"),
    ],
)
def test_scenarios(spark, since, version, mode, status):
    frame = spark.createDataFrame([(since, version, mode)], "since STRING, version STRING, mode STRING")
    assert frame.select(effective_support("since", version, mode)).first()[0] == status
    assert frame.select(effective_support("since", F.col("version"), F.col("mode"))).first()[0] == status


def test_versions_keep_their_order(spark):
    frame = spark.createDataFrame([("26 AI and 19C, 19c; 5c5",)], "since STRING")
    assert frame.select(versions_in("since")).first()[0] == ["26ai", "19c"]


SUPPORT = "row_id LONG, section STRING, command STRING, stage STRING, operator STRING, support_since STRING, normalized_status STRING"


def support(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SUPPORT)


def test_first_support_row_wins(spark):
    table = support(
        spark,
        ("S1", " Find ", "", "", "", "Other"),
        ("S2", "find", "", "", "19c", ""),
        ("S3", "", "$match", "", "", ""),
        ("S4", "", "", "$cond", "26ai", ""),
    )
    usage = spark.createDataFrame([("command", "FIND"), ("stage", "$match"), ("expression", "$cond"), ("operator", "$none"), ("stage", "$cond")], "feature_type STRING, feature_name STRING")
    got = {(r[0], r[1]): tuple(r)[2:] for r in map_support(usage, table).collect()}
    assert got["command", "FIND"] == ("Other", "", "S1", "Find")
    assert got["stage", "$match"] == ("Unknown", "", "S3", "$match")
    assert got["expression", "$cond"] == ("Supported", "26ai", "S4", "$cond")
    assert got["operator", "$none"] == got["stage", "$cond"] == ("Unknown", "", "", "")


def test_up_to_three_rows_per_support_row(spark):
    rows = support_as_usage(support(spark, ("S", "find", "$match", "$gt", "19c", "Supported"), ("S", "nan", "", " ", "", ""))).collect()
    assert sorted((r.feature_type, r.feature_name, r.command_name) for r in rows) == [
        ("command", "find", "find"),
        ("operator", "$gt", "find"),
        ("stage", "$match", "aggregate"),
    ]


def test_status_column_choice():
    assert status_column(["a", "support_since"]) == "support_since"
    assert status_column(["a", "My Status"]) == "My Status"
    assert status_column(["a"]) is None
