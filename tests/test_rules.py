from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from portlens.sources.rules import (
    OVERRIDE_COLUMNS,
    OVERRIDE_VOCABULARY,
    RULE_COLUMNS,
    RULE_VOCABULARY,
    built_in_rules,
    invalid_values,
    normalize_overrides,
    overrides_from_baseline,
    read_overrides,
    read_rules,
    require_valid,
    require_valid_rules,
    save_overrides,
    small_table,
)


def test_built_in_rules_are_valid(spark):
    rules = built_in_rules(spark)
    require_valid_rules(rules)
    kinds = {r[0]: r[1] for r in rules.groupBy("feature_type").count().collect()}
    assert kinds == {"command": 33, "stage": 17, "operator": 24, "expression": 13}


def test_rule_folder(spark, tmp_path):
    (tmp_path / "rules_manifest.json").write_text(json.dumps({"rules_version": "v9", "files": ["a.csv", "b.csv"]}, indent=1))
    (tmp_path / "a.csv").write_text("﻿feature_name,feature_type,default_complexity,enabled\n find ,command,Low,TRUE\nskip,command,Low,false\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('enabled,feature_name,feature_type,complexity_reason\nyes,find,command,"a, ""quoted"" reason"\n')
    rules, version = read_rules(spark, str(tmp_path))
    rows = rules.orderBy("ordinal").collect()
    assert version == "v9" and [r.feature_name for r in rows] == ["find", "find"]
    assert rows[1].complexity_reason == 'a, "quoted" reason' and rows[1].migration_scope == "" and rows[0].default_complexity == "Low"
    assert rules.columns[: len(RULE_COLUMNS)] == list(RULE_COLUMNS)


def test_vocabulary(spark):
    bad = small_table(spark, OVERRIDE_COLUMNS, [("stage", "$a", "everything", "Low", "", "", "true"), ("stage", "$b", "", "hard", "", "guess", "true")])
    assert {(r.column_name, r.value) for r in invalid_values(bad, OVERRIDE_VOCABULARY).collect()} == {
        ("override_scope", "everything"),
        ("override_complexity", "hard"),
        ("override_action", "guess"),
    }
    with pytest.raises(ValueError, match="customer overrides contains invalid values: everything, guess, hard"):
        require_valid(bad, OVERRIDE_VOCABULARY, "customer overrides")
    assert set(RULE_VOCABULARY) < set(RULE_COLUMNS)


def test_override_round_trip(spark, tmp_path):
    edited = spark.createDataFrame(
        [("stage", "$b", " High ", "", False), ("stage", "$a", "", 'it\'s "odd", really', False), ("command", "c", "", "", True), ("command", "d", " ", None, None)],
        "feature_type STRING, feature_name STRING, override_complexity STRING, override_reason STRING, override_enabled BOOLEAN",
    )
    path = str(tmp_path / "overrides")
    save_overrides(overrides_from_baseline(edited), path)
    rows = read_overrides(spark, path).orderBy("feature_type", "feature_name").collect()
    assert [(r.feature_name, r.override_complexity) for r in rows] == [("c", ""), ("$a", ""), ("$b", "High")]
    assert rows[1].override_reason == 'it\'s "odd", really'
    wrong = small_table(spark, OVERRIDE_COLUMNS, [("stage", "$a", "", "harder", "", "", "true")])
    with pytest.raises(ValueError, match="harder"):
        save_overrides(wrong, path)


def test_no_overrides(spark):
    assert normalize_overrides(small_table(spark, OVERRIDE_COLUMNS, [])).count() == 0


def test_the_last_row_counts_across_files_and_parts(spark, tmp_path):
    columns = ",".join(RULE_COLUMNS)

    def lines(*names: str) -> str:
        return columns + "\n" + "".join(f"$x,operator,query,high,false,{n},{n},,,,true\n" for n in names)

    (tmp_path / "first").mkdir()
    (tmp_path / "first" / "part-0000.csv").write_text(lines("Low"))
    (tmp_path / "first" / "part-0001.csv").write_text(lines("High", "Medium"))
    (tmp_path / "second.csv").write_text(lines("Blocker"))
    for files, last in ((["first"], "Medium"), (["first", "second.csv"], "Blocker"), (["second.csv", "first"], "Medium")):
        (tmp_path / "rules_manifest.json").write_text(json.dumps({"rules_version": "1", "files": files}))
        rules, _ = read_rules(spark, str(tmp_path))
        row = rules.groupBy("feature_name").agg(F.max_by("default_complexity", "ordinal").alias("last")).first()
        assert row["last"] == last
