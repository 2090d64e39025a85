"""Usage against the target's feature-support table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens.functions.naming import present
from portlens.functions.support import effective_support, raw_status
from portlens.functions.text import blank, match_key, or_default, squash

SUPPORT_COLUMNS = ("row_id", "section", "command", "stage", "operator", "support_since", "normalized_status")


def with_status(support: DataFrame, status_column: str | None = "support_since") -> DataFrame:
    """Add the status that the support cell names on its own."""
    status = F.lit("Other") if status_column is None else raw_status(status_column)
    return support.withColumn("normalized_status", status)


def status_column(columns: list[str]) -> str | None:
    """The column that tells support: by its usual name, else by any hint."""
    if "support_since" in columns:
        return "support_since"
    hints = [c for c in columns if "support" in c.lower() or "status" in c.lower()]
    return hints[0] if hints else None


def first_support_rows(support: DataFrame) -> DataFrame:
    """First row per kind and folded name.

    Rows are reduced map-side, so a name repeated in a third of the table
    stays cheap.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), blank(kind).alias("name")) for kind in ("command", "stage", "operator")])
    feature = F.coalesce(*[F.nullif(squash(c), F.lit("")) for c in ("command", "stage", "operator")])
    since = squash("support_since")
    status = F.when(since != "", raw_status(since)).otherwise(or_default("normalized_status", "Unknown"))
    rows = support.select(
        "row_id",
        since.alias("target_support_since"),
        status.alias("target_support_status"),
        squash("section").alias("target_category"),
        feature.alias("target_feature"),
        F.inline(kinds),
    ).filter(F.trim("name") != "")
    picked = F.min_by(
        F.struct("target_support_status", "target_support_since", "target_category", "target_feature"), F.col("row_id")
    )
    return rows.groupBy("kind", match_key("name").alias("folded")).agg(picked.alias("match"))


def map_support(usage: DataFrame, support: DataFrame) -> DataFrame:
    """Add support status, since, category and feature; unmatched is Unknown."""
    kind = F.when(F.col("feature_type") == "expression", "operator").otherwise(F.col("feature_type"))
    keyed = usage.withColumns({"kind": kind, "folded": match_key("feature_name")})
    joined = keyed.join(first_support_rows(support), ["kind", "folded"], "left")
    return joined.select(
        *usage.columns,
        F.coalesce("match.target_support_status", F.lit("Unknown")).alias("target_support_status"),
        F.coalesce("match.target_support_since", F.lit("")).alias("target_support_since"),
        F.coalesce("match.target_category", F.lit("")).alias("target_category"),
        F.coalesce("match.target_feature", F.lit("")).alias("target_feature"),
    )


def retarget(frame: DataFrame, version: str, mode: str, since: str = "target_support_since", status: str = "target_support_status") -> DataFrame:
    """Recompute the status for one target version and mode."""
    return frame.withColumn(status, effective_support(since, version, mode))


def _pseudo_usage(kind: Column, name: Column, command: Column, status: Column, since: Column, category: Column, description: Column) -> list[Column]:
    return [
        kind.alias("feature_type"),
        name.alias("feature_name"),
        command.alias("command_name"),
        F.lit("").alias("op_type"),
        F.lit("").alias("database"),
        F.lit("").alias("collection"),
        F.lit(1).cast("bigint").alias("usage_count"),
        F.lit("").alias("first_seen"),
        F.lit("").alias("last_seen"),
        F.lit(None).cast("bigint").alias("max_duration_ms"),
        F.lit("").alias("sample_path"),
        F.lit("").alias("sample_value"),
        status.alias("target_support_status"),
        since.alias("target_support_since"),
        category.alias("target_category"),
        description.alias("source_short_description"),
    ]


def support_as_usage(support: DataFrame) -> DataFrame:
    """Each support row as one use of every feature it names (up to three)."""
    command, stage, operator = present("command"), present("stage"), present("operator")

    def spec(kind: str, name: Column, context: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), context.alias("context"))

    specs = F.filter(
        F.array(spec("command", command, command), spec("stage", stage, F.lit("aggregate")), spec("operator", operator, command)),
        lambda s: s["name"] != "",
    )
    description = blank("source_short_description") if "source_short_description" in support.columns else F.lit("")
    rows = support.withColumn("spec", F.explode(specs))
    return rows.select(
        *_pseudo_usage(
            F.col("spec.kind"),
            F.col("spec.name"),
            F.col("spec.context"),
            F.coalesce(F.nullif(blank("normalized_status"), F.lit("")), F.lit("Unknown")),
            blank("support_since"),
            blank("section"),
            description,
        )
    )


def mapping_as_usage(mapping: DataFrame, baseline: DataFrame, version: str, mode: str) -> DataFrame:
    """Each mapping row as one use, with its status in a target scenario."""
    described = baseline.select("feature_type", "feature_name", "source_short_description")
    joined = mapping.join(described, ["feature_type", "feature_name"], "left")
    kind, name, since = present("feature_type"), present("feature_name"), present("target_support_since")
    command = F.when(kind == "command", name).when(kind == "stage", "aggregate").otherwise("")
    return joined.filter((kind != "") & (name != "")).select(
        *_pseudo_usage(
            kind, name, command, effective_support(since, version, mode), since, present("target_section"), present("source_short_description")
        )
    )
