"""Support texts: raw status, versions and the status in a target scenario."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from portlens import fixed
from portlens.functions.text import ColumnOrName, blank, col, contains_any


def raw_status(value: ColumnOrName) -> Column:
    """Status named by a support cell on its own, whatever the target."""
    low = F.trim(F.lower(blank(value)))
    return (
        F.when(low.contains("no-op"), "Supported")
        .when(contains_any(low, ("not supported", "unsupported")), "Not Supported")
        .when(low.isin(*fixed.NEGATIVE_WORDS) | low.contains("not applicable"), "Not Supported")
        .when(contains_any(low, ("partial", "limited")), "Partially Supported")
        .when(contains_any(low, ("supported", "yes", "full")), "Supported")
        .when(low.rlike(r"\d") | low.contains("always"), "Supported")
        .otherwise("Other")
    )


def versions_in(value: ColumnOrName) -> Column:
    """Distinct target versions named in a text, in order of appearance."""
    tokens = F.regexp_extract_all(blank(value), F.lit(fixed.VERSION_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"\s+", ""))))


def version_rank(value: Column) -> Column:
    """Comparable rank of a version; NULL where the text is no version."""
    low = F.lower(F.regexp_replace(F.trim(blank(value)), " ", ""))
    number = F.nullif(F.regexp_extract(low, r"^(\d+)(ai|c)$", 1), F.lit("")).try_cast("bigint")
    return number * 2 + F.when(low.endswith("ai"), 1).otherwise(0)


def mode_of(value: ColumnOrName) -> Column:
    low = F.lower(F.trim(blank(value)))
    return F.when(low.isin(*fixed.ANY_MODE), "any").when(low.isin(*fixed.NO_OP_MODE), "no-op").otherwise("op")


def effective_support(since: ColumnOrName, version: Column | str, mode: Column | str) -> Column:
    """Status of a feature for one target version and deployment mode.

    `version` and `mode` are texts or columns; an "any" value is satisfied by
    every version named in the cell, and by either mode.
    """
    version = F.lit(version) if isinstance(version, str) else version
    mode = mode_of(F.lit(mode) if isinstance(mode, str) else mode)
    text = F.trim(blank(since))
    low = F.lower(text)
    negative = contains_any(low, fixed.NEGATIVE_PHRASES) | low.isin(*fixed.NEGATIVE_WORDS)

    named = versions_in(text)
    candidates = F.when(F.size(named) > 0, named).otherwise(F.lit(list(fixed.DEFAULT_VERSIONS)))
    wanted = F.trim(blank(version))
    versions = F.when(wanted.isin(*fixed.ANY_VERSION), candidates).otherwise(
        F.array(F.lower(F.regexp_replace(wanted, " ", "")))
    )
    modes = F.when(mode == "any", F.lit(list(fixed.MODES))).otherwise(F.array(mode))

    # A version in parentheses needs the no-op mode once the cell mentions it;
    # what stands outside gives the first version that has the feature.
    in_parentheses = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), versions_in)
    )
    no_op_only = F.when(low.contains("no-op"), in_parentheses).otherwise(F.array().cast("array<string>"))
    base = versions_in(F.regexp_replace(text, r"\([^)]*\)", " "))
    first_rank = F.array_min(F.transform(base, version_rank))

    def qualifies(candidate: Column, in_mode: Column) -> Column:
        bare = (in_mode == "no-op") & candidate.isin(*fixed.DEFAULT_VERSIONS)
        listed = (in_mode == "no-op") & F.array_contains(no_op_only, candidate)
        reached = F.coalesce(version_rank(candidate) >= first_rank, F.lit(False))
        return F.when(low == "no-op", bare).otherwise(listed | reached)

    supported = F.exists(versions, lambda v: F.exists(modes, lambda m: qualifies(v, m)))
    return (
        F.when(text == "", "Unknown")
        .when(negative, "Not Supported")
        .when(supported, "Supported")
        .otherwise("Not Supported")
    )


def scenario_status(version: str | None = None, mode: str | None = None, column: ColumnOrName = "target_support_since") -> Column:
    """Shorthand: the status of `column` with open ends read as "any"."""
    return effective_support(col(column), version or "any", mode or "any")
