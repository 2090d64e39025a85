"""From documentation pages to the assessed API baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from portlens.operators.assess import Platforms, assess
from portlens.operators.catalog import (
    catalog_from_rows,
    compatibility_mapping,
    describe_baseline,
    documented_baseline,
    enrich_support,
    joined_baseline,
    merge_baseline,
    observe_baseline,
    show_overrides,
)
from portlens.operators.reports import api_baseline, observed_rollup
from portlens.operators.support import mapping_as_usage, retarget, support_as_usage, with_status
from portlens.sources.pages import reference_rows, support_rows


@dataclass(frozen=True)
class Catalog:
    catalog: DataFrame
    support: DataFrame
    baseline: DataFrame
    mapping: DataFrame
    assessed: DataFrame


def sync(
    support_pages: DataFrame,
    reference_pages: DataFrame,
    rules: DataFrame,
    overrides: DataFrame | None = None,
    supplemental: DataFrame | None = None,
    version: str = "any",
    mode: str = "any",
    manual_version: str = "",
    synced_at: str = "",
    platforms: Platforms = Platforms(),
) -> Catalog:
    """Catalogue, enriched support table, baseline, mapping and its assessment."""
    catalog = catalog_from_rows(reference_rows(reference_pages)).withColumn("last_synced_at", F.lit(synced_at))
    support = enrich_support(with_status(support_rows(support_pages)), catalog)
    support = retarget(support, version, mode, since="support_since", status="normalized_status")
    baseline = documented_baseline(catalog, manual_version)
    if supplemental is not None:
        baseline = merge_baseline(baseline, supplemental, manual_version)
    mapping = compatibility_mapping(baseline, support)
    usage = mapping_as_usage(mapping, baseline, version, mode)
    assessed = joined_baseline(api_baseline(assess(usage, rules, overrides, platforms=platforms)), baseline, mapping)
    return Catalog(catalog, support, baseline, mapping, assessed)


def catalog_baseline(
    support: DataFrame,
    usage: DataFrame,
    rules: DataFrame,
    overrides: DataFrame | None,
    version: str,
    mode: str,
    fold_expression: bool = False,
) -> DataFrame:
    """All features of the support table for one scenario, with observed use and overrides."""
    targeted = retarget(support, version, mode, since="support_since", status="normalized_status")
    rolled = api_baseline(assess(support_as_usage(targeted), rules, overrides))
    described = describe_baseline(rolled, support)
    observed = observe_baseline(described, observed_rollup(usage, fold_expression))
    return observed if overrides is None else show_overrides(observed, overrides)
