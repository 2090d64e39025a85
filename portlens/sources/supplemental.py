"""Supplemental feature lists: a JSON object from feature name to details."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from portlens.functions.naming import feature_type_of, source_group_of
from portlens.functions.text import blank, clean_text
from portlens.operators.catalog import BASELINE_COLUMNS


@dataclass(frozen=True)
class EntryFields:
    """Field names of an entry; lists from different vendors differ in them."""

    categories: str = "doc_categories"
    details: str = "target_details"
    ignore: str = "ignore"


def _category(c: Column) -> Column:
    joined = F.concat(clean_text(c.category_level_0), F.lit(" / "), clean_text(c.category_level_1))
    return clean_text(F.regexp_replace(joined, r"^[ /]+|[ /]+$", ""))


def supplemental_entries(documents: DataFrame, fields: EntryFields = EntryFields()) -> DataFrame:
    """Baseline rows of supplemental documents (columns: source_ref, document).

    Names with spaces, and capitalised names without `$`, are no features.
    """
    entries = documents.select("source_ref", F.explode(F.from_json("document", "map<string,string>")).alias("raw_name", "payload"))
    entries = entries.filter(F.json_object_keys(F.col("payload")).isNotNull())
    schema = (
        f"`{fields.categories}` ARRAY<STRUCT<category_level_0 STRING, category_level_1 STRING>>, "
        f"`{fields.details}` STRUCT<notes STRING>, `{fields.ignore}` BOOLEAN"
    )
    name = clean_text("raw_name")
    initial = F.substr(name, F.lit(1), F.lit(1))
    is_feature = ~name.contains(" ") & (name.startswith("$") | (F.lower(initial) == initial))
    opened = entries.filter(is_feature).select("source_ref", name.alias("feature_name"), F.from_json("payload", schema).alias("p"))
    raw = F.col(f"p.`{fields.categories}`")
    categories = F.coalesce(raw, F.filter(F.array(F.struct(F.lit("").alias("category_level_0"), F.lit("").alias("category_level_1"))), lambda x: F.lit(False)))
    texts = F.array_distinct(F.filter(F.transform(categories, _category), lambda t: t != ""))
    category = F.array_join(texts, " | ")
    notes = clean_text(F.col(f"p.`{fields.details}`.notes"))
    group = source_group_of(F.col("feature_name"), categories)
    ignore = F.coalesce(F.col(f"p.`{fields.ignore}`"), F.lit(False))
    remarks = F.array(
        F.when((notes != "") & (F.lower(notes) != "none"), notes),
        F.when(category != "", F.concat(F.lit("Supplemental categories: "), category)),
    )
    return opened.select(
        feature_type_of("feature_name", group, categories).alias("feature_type"),
        "feature_name",
        group.alias("source_group"),
        category.alias("source_category"),
        F.lit("").alias("source_short_description"),
        F.lit("").alias("source_doc_url"),
        F.lit("").alias("source_manual_version"),
        F.lit("supplemental_json").alias("baseline_source_kind"),
        blank("source_ref").alias("baseline_source_ref"),
        ignore.alias("admin_operational_flag"),
        ignore.alias("ignore_candidate_from_source"),
        F.lit(False).alias("deprecated_flag"),
        F.array_join(F.filter(remarks, lambda x: x.isNotNull()), " | ").alias("availability_notes"),
        F.lit("").alias("aliases_json"),
    ).select(*BASELINE_COLUMNS)
