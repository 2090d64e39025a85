"""Saved runs: one folder per table, partitioned by run."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from portlens.functions.text import ColumnOrName, col
from portlens.operators.catalog import BASELINE_FLAGS, catalog_texts, parse_flags
from portlens.operators.reports import support_summary
from portlens.sources.rules import OVERRIDE_VOCABULARY, normalize_overrides, override_texts, require_valid
from portlens.sources.versions import publish

RUN_TABLES = ("detail", "summary", "migration_detail", "migration_summary", "migration_hotspots", "migration_excluded")


def save_table(frame: DataFrame, root: str, table: str, run_id: str) -> None:
    tagged = frame.withColumn("run_id", F.lit(run_id))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{table}")


def save_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], metadata: dict[str, object]) -> None:
    """Tables of one analysis and its metadata as one JSON row."""
    for name, frame in tables.items():
        save_table(frame, root, name, run_id)
    row = spark.createDataFrame([(json.dumps(metadata, ensure_ascii=False, default=str),)], "metadata STRING")
    save_table(row, root, "metadata", run_id)


def latest(frame: DataFrame, run: ColumnOrName = "run_id") -> DataFrame:
    """Rows of the newest run."""
    newest = frame.agg(F.max(col(run)).alias("newest")).scalar()
    return frame.filter(col(run) == newest)


def load_table(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """One table of a run, the newest if none is named."""
    reader = spark.read.option("mergeSchema", True).option("recursiveFileLookup", False)
    frame = reader.parquet(f"{root}/{table}").withColumn("run_id", F.col("run_id").cast("string"))
    return latest(frame) if run_id is None else frame.filter(F.col("run_id") == run_id)


def load_run(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """All tables a run has; older runs may lack the migration tables."""
    tables = {}
    for name in (*RUN_TABLES, "metadata"):
        try:
            tables[name] = load_table(spark, root, name, run_id)
        except AnalysisException as missing:
            if name in ("detail", "summary") or "PATH_NOT_FOUND" not in str(missing):
                raise
    return tables


def save_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Saved text table; blank cells come back as empty texts."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0")
    return read.csv(path).na.fill("")


def save_catalog(baseline: DataFrame, mapping: DataFrame, root: str) -> None:
    save_csv(catalog_texts(baseline, BASELINE_FLAGS), f"{root}/api_baseline")
    save_csv(catalog_texts(mapping, ("target_matched",)), f"{root}/compat_mapping")


def publish_catalog(baseline: DataFrame, mapping: DataFrame, root: str, manual_version: str = "", synced_at: str = "") -> str:
    """Baseline and mapping as one version, with the counts that the catalogue view shows."""
    counts = mapping.agg(F.count(F.lit(1)).alias("all"), F.count_if("target_matched").alias("matched")).first()
    info = {"manual_version": manual_version, "synced_at": synced_at, "mapping_count": counts["all"], "matched_count": counts["matched"]}
    return publish(root, {"api_baseline": baseline, "compat_mapping": mapping}, info)


def publish_support(support: DataFrame, root: str, pages: DataFrame | None = None) -> str:
    """Support rows with their summary and what is known of their pages, as one version."""
    tables = {"support": support, "summary": support_summary(support)}
    return publish(root, tables | ({} if pages is None else {"pages": pages}))


def publish_overrides(overrides: DataFrame, root: str) -> str:
    """Checked override rows, as one version; a value outside the vocabulary leaves the present one in place."""
    shaped = override_texts(overrides)
    require_valid(normalize_overrides(shaped), OVERRIDE_VOCABULARY, "customer overrides")
    return publish(root, {"overrides": shaped})


def load_catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return (
        parse_flags(read_csv(spark, f"{root}/api_baseline"), BASELINE_FLAGS),
        parse_flags(read_csv(spark, f"{root}/compat_mapping"), ("target_matched",)),
    )
