"""Reference catalogue, API baseline and compatibility mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.naming import feature_type_of, present, support_key
from portlens.functions.text import blank, clean_text, is_true, true_text

CATALOG_KEYS = ("entity_type", "source_group", "name")
BASELINE_TEXT = ("source_group", "source_category", "baseline_source_ref", "availability_notes", "baseline_source_kind")
BASELINE_FLAGS = ("admin_operational_flag", "ignore_candidate_from_source", "deprecated_flag")
BASELINE_FIRST = ("source_short_description", "source_doc_url", "source_manual_version", "aliases_json")
BASELINE_COLUMNS = (
    "feature_type",
    "feature_name",
    "source_group",
    "source_category",
    "source_short_description",
    "source_doc_url",
    "source_manual_version",
    "baseline_source_kind",
    "baseline_source_ref",
    "admin_operational_flag",
    "ignore_candidate_from_source",
    "deprecated_flag",
    "availability_notes",
    "aliases_json",
)


def content_hash(name: str = "name", group: str = "source_group", description: str = "short_description", url: str = "doc_url") -> Column:
    return F.sha2(F.concat_ws("|", *[blank(c) for c in (name, group, description, url)]), 256)


def catalog_from_rows(rows: DataFrame) -> DataFrame:
    """First row per (entity_type, source_group, name), with its fingerprint.

    `ordinal` tells which row comes first.
    """
    rest = [c for c in rows.columns if c not in CATALOG_KEYS]
    first = rows.groupBy(*CATALOG_KEYS).agg(F.min_by(F.struct(*rest), F.col("ordinal")).alias("_row"))
    return first.select(*CATALOG_KEYS, "_row.*").withColumn("content_hash", content_hash())


def catalog_order() -> list[Column]:
    return [F.asc("source_group"), F.asc("category"), F.asc("name")]


def entries_per_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_label", "source_page_url", "source_group").agg(F.count(F.lit(1)).alias("entry_count"))


def catalog_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """New keys and keys whose content changed; removed keys are not reported."""
    known = previous.select(*CATALOG_KEYS, F.col("content_hash").alias("previous_hash"), F.lit(True).alias("known"))
    joined = current.join(known, list(CATALOG_KEYS), "left")
    change = F.when(F.col("known").isNull(), "new").when(~F.col("previous_hash").eqNullSafe(F.col("content_hash")), "updated")
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).select(*CATALOG_KEYS, "change")


def catalog_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    known = previous.select(*CATALOG_KEYS, F.col("content_hash").alias("previous_hash"), F.lit(True).alias("known"))
    changed = ~F.col("previous_hash").eqNullSafe(F.col("content_hash"))
    return current.join(known, list(CATALOG_KEYS), "left").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(F.col("known").isNull()).alias("new_entry_count"),
        F.count_if(F.col("known").isNotNull() & changed).alias("updated_entry_count"),
        F.count_distinct("source_group").alias("source_count"),
    )


def version_change(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict on each document against its previous snapshot."""
    before = previous.select(
        *keys, F.col("doc_id").alias("previous_doc_id"), F.col("doc_version_date").alias("previous_doc_version_date"), F.lit(True).alias("_seen")
    )
    joined = current.join(before, keys, "left")
    unreadable = (blank("doc_id") == "") & (blank("doc_version_date") == "")
    moved = (blank("doc_id") != blank("previous_doc_id")) | (blank("doc_version_date") != blank("previous_doc_version_date"))
    verdict = (
        F.when(F.col("_seen").isNull(), fixed.CHANGE_FIRST)
        .when(unreadable, fixed.CHANGE_UNREADABLE)
        .when(moved, fixed.CHANGE_FOUND)
        .otherwise(fixed.CHANGE_NONE)
    )
    return joined.withColumns(
        {
            "update_status": verdict,
            "previous_doc_id": blank("previous_doc_id"),
            "previous_doc_version_date": blank("previous_doc_version_date"),
        }
    ).drop("_seen")


def _by_feature(entries: DataFrame, listed: tuple[str, ...], firsts: tuple[str, ...]) -> DataFrame:
    """Text columns of each feature: distinct texts in order, or the first one.

    Texts are reduced to one row per distinct text before they are gathered,
    so a feature's state grows with its distinct texts, not with its rows.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in (*listed, *firsts)])
    keys = ["feature_type", "feature_name"]
    texts = (
        entries.select(*keys, "ordinal", F.inline(cells))
        .filter(F.col("text") != "")
        .groupBy(*keys, "field", "text")
        .agg(F.min("ordinal").alias("ordinal"))
    )
    mine = lambda c, value: F.when(F.col("field") == c, value)

    def in_order(c: str) -> Column:
        gathered = F.array_sort(F.collect_list(mine(c, F.struct("ordinal", "text"))))
        return F.array_join(F.transform(gathered, lambda x: x.text), " | ").alias(c)

    def first(c: str) -> Column:
        return F.coalesce(F.min_by(mine(c, F.col("text")), mine(c, F.col("ordinal"))), F.lit("")).alias(c)

    return texts.groupBy(*keys).agg(*[in_order(c) for c in listed], *[first(c) for c in firsts])


def documented_baseline(catalog: DataFrame, manual_version: str = "") -> DataFrame:
    """Baseline entries from the reference catalogue, one per feature."""
    name = clean_text("name")
    entries = catalog.filter(name != "").select(
        feature_type_of(name, clean_text("source_group")).alias("feature_type"),
        name.alias("feature_name"),
        "ordinal",
        clean_text("source_group").alias("source_group"),
        clean_text("category").alias("source_category"),
        clean_text("short_description").alias("source_short_description"),
        clean_text("doc_url").alias("source_doc_url"),
        F.lit("reference_docs").alias("baseline_source_kind"),
        clean_text("source_page_url").alias("baseline_source_ref"),
    )
    rolled = _by_feature(
        entries,
        ("source_group", "source_category", "baseline_source_ref"),
        ("source_short_description", "source_doc_url", "baseline_source_kind"),
    )
    constants = {"source_manual_version": F.lit(manual_version), "availability_notes": F.lit(""), "aliases_json": F.lit("")}
    return rolled.withColumns(constants | {flag: F.lit(False) for flag in BASELINE_FLAGS}).select(*BASELINE_COLUMNS)


def merge_baseline(documented: DataFrame, supplemental: DataFrame, manual_version: str = "") -> DataFrame:
    """Documented and supplemental entries side by side, column by column."""
    left, right = documented.alias("l"), supplemental.alias("r")
    joined = left.join(right, ["feature_type", "feature_name"], "full_outer")

    def side(name: str) -> tuple[Column, Column]:
        return F.col(f"l.{name}"), F.col(f"r.{name}")

    merged = {}
    for name in BASELINE_FLAGS:
        merged[name] = F.coalesce(side(name)[0], F.lit(False)) | F.coalesce(side(name)[1], F.lit(False))
    for name in BASELINE_TEXT:
        texts = F.array(*[clean_text(c) for c in side(name)])
        merged[name] = F.array_join(F.array_distinct(F.filter(texts, lambda t: t != "")), " | ")
    for name in BASELINE_FIRST:
        a, b = side(name)
        merged[name] = F.coalesce(F.when(F.trim(blank(a)) != "", a), b, F.lit(""))
    merged["source_manual_version"] = F.coalesce(F.nullif(F.trim(merged["source_manual_version"]), F.lit("")), F.lit(manual_version))
    return joined.select("feature_type", "feature_name", *[v.alias(k) for k, v in merged.items()]).select(*BASELINE_COLUMNS)


def compatibility_mapping(baseline: DataFrame, support: DataFrame, support_loaded: bool = True) -> DataFrame:
    """Every distinct support row of each baseline feature, or why there is none."""
    keyed = support.select(
        F.inline(F.array(support_key("section", "command", "stage", "operator"))),
        clean_text("section").alias("target_section"),
        clean_text("support_since").alias("target_support_since"),
    )
    rows = (
        keyed.filter((F.col("feature_type") != "") & (F.col("feature_name") != ""))
        .select("feature_type", "feature_name", "target_section", "target_support_since", F.lit(True).alias("target_matched"))
        .distinct()
    )
    names = baseline.select(clean_text("feature_type").alias("feature_type"), clean_text("feature_name").alias("feature_name"))
    matched = F.coalesce("target_matched", F.lit(False))
    reason = fixed.UNCOVERED if support_loaded else fixed.SUPPORT_NOT_LOADED
    return names.join(rows, ["feature_type", "feature_name"], "left").select(
        "feature_type",
        "feature_name",
        matched.alias("target_matched"),
        F.when(matched, "exact").otherwise("unmatched").alias("target_match_type"),
        F.when(matched, "1.00").otherwise("0.00").alias("target_match_confidence"),
        blank("target_section").alias("target_section"),
        blank("target_support_since").alias("target_support_since"),
        blank("target_support_since").alias("target_support_raw"),
        F.when(matched, "").otherwise(reason).alias("target_uncovered_reason"),
    )


def empty_mapping(baseline: DataFrame) -> DataFrame:
    """Stand-in for a mapping that has not been built yet."""
    return baseline.select(
        "feature_type",
        "feature_name",
        F.lit(False).alias("target_matched"),
        F.lit("").alias("target_section"),
        F.lit("").alias("target_support_since"),
        F.lit(fixed.MAPPING_NOT_BUILT).alias("target_uncovered_reason"),
    )


def mapping_order() -> list[Column]:
    return [F.asc("feature_type"), F.asc("feature_name"), F.desc("target_matched"), F.asc("target_section"), F.asc("target_support_since")]


def mapping_rollup(mapping: DataFrame) -> DataFrame:
    reasons = F.array_sort(F.collect_set(F.when(F.trim(blank("target_uncovered_reason")) != "", F.col("target_uncovered_reason"))))
    return mapping.groupBy("feature_type", "feature_name").agg(
        F.bool_or("target_matched").alias("target_matched"), F.array_join(reasons, ", ").alias("target_uncovered_reason")
    )


def baseline_metadata(baseline: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entry counts of baseline and mapping, as (metric, value) rows."""
    groups = F.explode(F.split("source_group", r" \| "))
    sources = baseline.filter(F.col("baseline_source_kind").contains("reference_docs")).select(groups.alias("g")).filter(F.col("g") != "")

    def value(metric: str, frame: DataFrame, count: Column) -> DataFrame:
        return frame.agg(count.alias("value")).select(F.lit(metric).alias("metric"), "value")

    matched = F.coalesce("target_matched", F.lit(False))
    parts = [
        value("entry_count", baseline, F.count(F.lit(1))),
        value("source_count", sources, F.count_distinct("g")),
        value("supplemental_entry_count", baseline, F.count_if(F.col("baseline_source_kind").contains("supplemental_json"))),
        value("mapping_entry_count", mapping, F.count(F.lit(1))),
        value("matched_count", mapping, F.count_if(matched)),
        value("uncovered_count", mapping, F.count_if(~matched)),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def enrich_support(support: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the reference description to support rows.

    The exact (type, group, name) entry wins; else the (type, name) entry if
    there is only one.
    """
    details = F.struct("short_description", "doc_url", "category", "last_synced_at")
    named = ["feature_type", "feature_name"]
    entries = catalog.select(F.col("entity_type").alias("feature_type"), "source_group", F.col("name").alias("feature_name"), details.alias("d"))
    exact = entries.groupBy(*named, "source_group").agg(F.max("d").alias("exact"))
    loose = entries.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("loose")).filter(F.col("n") == 1).drop("n")
    keyed = support.select("*", F.inline(F.array(support_key("section", "command", "stage", "operator"))))
    joined = keyed.join(exact, [*named, "source_group"], "left").join(loose, named, "left")
    hit = F.coalesce("exact", "loose")
    return joined.select(
        *support.columns,
        F.col("feature_type").alias("source_entity_type"),
        "source_group",
        F.col("feature_name").alias("source_name"),
        blank(hit["short_description"]).alias("source_short_description"),
        blank(hit["doc_url"]).alias("source_doc_url"),
        blank(hit["category"]).alias("source_reference_category"),
        blank(hit["last_synced_at"]).alias("source_last_synced_at"),
    )


def joined_baseline(assessed_baseline: DataFrame, baseline: DataFrame, mapping: DataFrame) -> DataFrame:
    """Assessed baseline with documentation columns and the mapping roll-up."""
    attributes = baseline.select(
        "feature_type",
        "feature_name",
        "source_group",
        "source_category",
        "source_short_description",
        "source_doc_url",
        "baseline_source_kind",
        "baseline_source_ref",
        *BASELINE_FLAGS,
        "availability_notes",
    )
    joined = assessed_baseline.join(attributes, ["feature_type", "feature_name"], "left").join(
        mapping_rollup(mapping), ["feature_type", "feature_name"], "left"
    )
    return joined.withColumns(
        {
            "target_matched": F.coalesce("target_matched", F.lit(False)),
            "target_uncovered_reason": blank("target_uncovered_reason"),
            "source_short_description": blank("source_short_description"),
        }
    )


def describe_baseline(baseline: DataFrame, support: DataFrame) -> DataFrame:
    """Add the description of the support row each baseline row came from."""
    command, stage, operator = present("command"), present("stage"), present("operator")
    kind = F.when(command != "", "command").when(stage != "", "stage").when(operator != "", "operator").otherwise("")
    name = F.coalesce(*[F.nullif(x, F.lit("")) for x in (command, stage, operator)], F.lit(""))
    rows = support.select(
        kind.alias("feature_type"),
        name.alias("feature_name"),
        blank("section").alias("target_section"),
        blank("support_since").alias("target_support_since"),
        "row_id",
        "source_short_description",
    ).filter((F.col("feature_type") != "") & (F.col("feature_name") != ""))
    keys = ["feature_type", "feature_name", "target_section", "target_support_since"]
    first = rows.groupBy(*keys).agg(F.min_by("source_short_description", "row_id").alias("source_short_description"))
    return baseline.join(first, keys, "left")


def observe_baseline(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """Add observed use; features never seen count zero."""
    joined = baseline.join(observed, ["feature_type", "feature_name"], "left")
    count = F.coalesce("observed_usage_count", F.lit(0)).cast("bigint")
    return joined.withColumns(
        {
            "observed_usage_count": count,
            "observed_command_contexts": blank("observed_command_contexts"),
            "observed_in_profile": count > 0,
        }
    )


def show_overrides(baseline: DataFrame, overrides: DataFrame) -> DataFrame:
    """Fill the override columns from loaded overrides where a feature has one; of several, the last row counts."""
    fields = ("override_scope", "override_complexity", "override_action", "override_reason")
    each = F.struct(*[F.col(f).alias(f"{f}_loaded") for f in fields], F.col("enabled").alias("override_enabled_loaded"))
    order = F.col("ordinal") if "ordinal" in overrides.columns else F.struct(*fields)
    loaded = overrides.groupBy("feature_type", "feature_name").agg(F.max_by(each, order).alias("_row")).select("feature_type", "feature_name", "_row.*")
    joined = baseline.join(loaded, ["feature_type", "feature_name"], "left")
    names = (*fields, "override_enabled")
    filled = joined.withColumns({f: F.coalesce(f"{f}_loaded", f) for f in names})
    return filled.drop(*[f"{f}_loaded" for f in names])


def catalog_texts(frame: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    """Flags as true/false text for text sinks; `parse_flags` reads them back."""
    return frame.withColumns({f: true_text(f) for f in flags})


def parse_flags(frame: DataFrame, flags: tuple[str, ...]) -> DataFrame:
    return frame.withColumns({f: is_true(f) for f in flags if f in frame.columns})
