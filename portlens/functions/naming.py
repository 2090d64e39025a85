"""Feature kinds and groups derived from names, categories and headings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from portlens.functions.text import ColumnOrName, blank, clean_text, col, contains_any, squash


def category_text(categories: ColumnOrName) -> Column:
    """Lower-case text of an array of (category_level_0, category_level_1)."""
    parts = F.transform(
        col(categories),
        lambda c: clean_text(F.concat(blank(c.category_level_0), F.lit(" "), blank(c.category_level_1))),
    )
    return F.lower(F.coalesce(F.array_join(parts, " | "), F.lit("")))


def feature_type_of(name: ColumnOrName, source_group: ColumnOrName, categories: Column | None = None) -> Column:
    group = blank(source_group)
    text = category_text(categories) if categories is not None else F.lit("")
    is_stage = contains_any(text, ("aggregation stage", "aggregate() stages"))
    return (
        F.when(group == "command", "command")
        .when(group == "aggregation_stage", "stage")
        .when(group != "", "operator")
        .when(~blank(name).startswith("$"), "command")
        .when(is_stage, "stage")
        .otherwise("operator")
    )


def source_group_of(name: ColumnOrName, categories: Column) -> Column:
    text = category_text(categories)
    return (
        F.when(~blank(name).startswith("$"), "command")
        .when(contains_any(text, ("aggregation stages", "aggregate() stages")), "aggregation_stage")
        .when(text.contains("update operators"), "update_operator")
        .when(text.contains("projection operators"), "projection_operator")
        .when(contains_any(text, ("query and projection operators", "query predicates")), "query_operator")
        .otherwise("expression_operator")
    )


def support_key(section: ColumnOrName, command: ColumnOrName, stage: ColumnOrName, operator: ColumnOrName) -> Column:
    """(feature_type, source_group, feature_name) a support row speaks about."""
    heading = F.lower(clean_text(section))
    cmd, stg, opr = clean_text(command), clean_text(stage), clean_text(operator)
    group = (
        F.when(heading.contains("update"), "update_operator")
        .when(heading.contains("projection"), "projection_operator")
        .when(heading.contains("query"), "query_operator")
        .otherwise("expression_operator")
    )

    def key(kind: str, source_group: Column | str, name: Column) -> Column:
        source_group = F.lit(source_group) if isinstance(source_group, str) else source_group
        return F.struct(F.lit(kind).alias("feature_type"), source_group.alias("source_group"), name.alias("feature_name"))

    return (
        F.when(cmd != "", key("command", "command", cmd))
        .when(stg != "", key("stage", "aggregation_stage", stg))
        .when(opr != "", key("operator", group, opr))
        .otherwise(key("", "", F.lit("")))
    )


def present(value: ColumnOrName) -> Column:
    """Non-blank text; the word `nan` left by older exports counts as blank."""
    text = squash(value)
    return F.when(F.lower(text) == "nan", "").otherwise(text)
