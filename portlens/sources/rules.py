"""Rule and override tables: reading, normalising, checking and saving."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from portlens import fixed
from portlens.functions.text import blank, is_true, true_text
from portlens.rule_table import RULES_CSV, RULES_VERSION

RULE_COLUMNS = (
    "feature_name",
    "feature_type",
    "migration_scope",
    "scope_confidence",
    "needs_review",
    "default_complexity",
    "complexity_reason",
    "recommended_action",
    "review_priority",
    "notes",
    "enabled",
)
OVERRIDE_COLUMNS = (
    "feature_type",
    "feature_name",
    "override_scope",
    "override_complexity",
    "override_reason",
    "override_action",
    "enabled",
)
RULE_VOCABULARY = {
    "migration_scope": fixed.SCOPES,
    "scope_confidence": fixed.SCOPE_CONFIDENCE,
    "default_complexity": fixed.COMPLEXITY,
    "recommended_action": fixed.ACTIONS,
    "review_priority": fixed.REVIEW_PRIORITY,
}
OVERRIDE_VOCABULARY = {
    "override_scope": fixed.SCOPES,
    "override_complexity": fixed.COMPLEXITY,
    "override_action": fixed.ACTIONS,
}


def small_table(spark: SparkSession, columns: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A literal table of a few rows, numbered in order as `ordinal`."""
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{c} STRING" for c in columns) + ", ordinal BIGINT")
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = ", ".join("(" + ", ".join(map(quoted, row)) + f", {n}L)" for n, row in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t({', '.join(columns)}, ordinal)")


def built_in_rules(spark: SparkSession) -> DataFrame:
    rows = [tuple(r[c] for c in RULE_COLUMNS) for r in csv.DictReader(io.StringIO(RULES_CSV))]
    return normalize_rules(small_table(spark, RULE_COLUMNS, rows))


def _tidy(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    present = {c.lstrip("\ufeff"): c for c in frame.columns}
    texts = [F.trim(blank(f"`{present[c]}`")).alias(c) if c in present else F.lit("").alias(c) for c in columns]
    return frame.select(*texts, *([] if "ordinal" not in frame.columns else ["ordinal"]))


def normalize_rules(rules: DataFrame) -> DataFrame:
    """Trimmed text, parsed flags, enabled rows only."""
    tidy = _tidy(rules, RULE_COLUMNS)
    return tidy.withColumns({"needs_review": is_true("needs_review"), "enabled": is_true("enabled")}).filter("enabled")


def normalize_overrides(overrides: DataFrame) -> DataFrame:
    tidy = _tidy(overrides, OVERRIDE_COLUMNS)
    return tidy.withColumn("enabled", is_true("enabled")).filter("enabled")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    numbered = Window.orderBy("_file", "_at")
    placed = read.csv(path).withColumns({"_file": F.col("_metadata.file_name"), "_at": F.monotonically_increasing_id()})
    # Files come in the order of their names. A list is written by hand and small; the row number is taken over all of it.
    return placed.withColumn("ordinal", F.row_number().over(numbered).cast("bigint")).drop("_file", "_at")


def read_rules(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Rules of the files that the manifest lists, and the rules version."""
    manifest = spark.read.option("multiLine", True).json(f"{folder}/rules_manifest.json").first().asDict()
    rules = None
    for number, name in enumerate(manifest.get("files") or []):
        part = _tidy(_read_csv(spark, f"{folder}/{name}"), RULE_COLUMNS)
        part = part.withColumn("ordinal", F.struct(F.lit(number).alias("list"), F.col("ordinal").alias("row")))
        rules = part if rules is None else rules.unionByName(part, allowMissingColumns=True)
    if rules is None:
        rules = small_table(spark, RULE_COLUMNS, [])
    return normalize_rules(rules), str(manifest.get("rules_version") or "")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return normalize_overrides(_read_csv(spark, path))


def invalid_values(frame: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside the vocabulary, with their column and number of rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(blank(c)).alias("value")) for c in vocabulary])
    allowed = F.lit(False)
    for column, words in vocabulary.items():
        allowed = allowed | ((F.col("column_name") == column) & F.col("value").isin(*words))
    return (
        frame.select(F.inline(cells))
        .filter((F.col("value") != "") & ~allowed)
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def require_valid(frame: DataFrame, vocabulary: dict[str, tuple[str, ...]], label: str) -> DataFrame:
    """The frame unchanged; fails and names the values outside the vocabulary."""
    bad = invalid_values(frame, vocabulary).select(F.array_sort(F.collect_set("value")).alias("v")).first()["v"]
    if bad:
        raise ValueError(f"{label} contains invalid values: {', '.join(bad)}")
    return frame


def require_valid_rules(rules: DataFrame, overrides: DataFrame | None = None) -> None:
    require_valid(rules, RULE_VOCABULARY, "migration rules")
    if overrides is not None:
        require_valid(overrides, OVERRIDE_VOCABULARY, "customer overrides")


def overrides_from_baseline(edited: DataFrame) -> DataFrame:
    """Override rows of an edited baseline: ticked ones and those with a complexity or reason."""
    complexity, reason = F.trim(blank("override_complexity")), F.trim(blank("override_reason"))
    ticked = F.coalesce(F.col("override_enabled"), F.lit(False))
    return edited.filter(ticked | (complexity != "") | (reason != "")).select(
        "feature_type",
        "feature_name",
        F.lit("").alias("override_scope"),
        complexity.alias("override_complexity"),
        reason.alias("override_reason"),
        F.lit("").alias("override_action"),
        F.lit("true").alias("enabled"),
    )


def override_texts(overrides: DataFrame) -> DataFrame:
    """Override rows as they are saved: trimmed text, flags as `true` and `false`."""
    return _tidy(overrides, OVERRIDE_COLUMNS).withColumn("enabled", true_text(is_true("enabled")))


def save_overrides(overrides: DataFrame, path: str) -> None:
    """Check and rewrite the override file, ordered by feature.

    Write to a folder other than the one being read.
    """
    shaped = override_texts(overrides)
    require_valid(normalize_overrides(shaped), OVERRIDE_VOCABULARY, "customer overrides")
    ordered = shaped.orderBy("feature_type", "feature_name")
    ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def rules_version() -> str:
    return RULES_VERSION
