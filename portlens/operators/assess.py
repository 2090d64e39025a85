"""Migration complexity, necessity and priority of used features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.text import (
    blank,
    higher,
    lookup,
    lower_of,
    match_key,
    or_default,
    rank_of,
    squash,
)


@dataclass(frozen=True)
class Platforms:
    """Names used in the texts of an assessment."""

    source: str = "source"
    target: str = "the target platform"
    vendor: str = "Target"

    def say(self, text: str) -> str:
        return text.replace("{source}", self.source).replace("{target}", self.target).replace("{vendor}", self.vendor)


ASSESSMENT_COLUMNS = (
    "default_scope",
    "effective_scope",
    "default_migration_necessity",
    "effective_migration_necessity",
    "migration_necessity_reason",
    "scope_confidence",
    "needs_review",
    "default_complexity",
    "effective_complexity",
    "complexity_reason",
    "complexity_explanation",
    "complexity_adjustment_reason",
    "recommended_action",
    "review_priority",
    "migration_priority",
    "priority_reason",
    "override_applied",
    "rule_source",
    "rules_version",
)


def last_by_feature(table: DataFrame, alias: str) -> DataFrame:
    """Last row per folded (feature_type, feature_name)."""
    values = [c for c in table.columns if c not in ("feature_type", "feature_name", "ordinal", "enabled", "notes")]
    return table.groupBy(match_key("feature_type").alias("_type"), match_key("feature_name").alias("_name")).agg(
        F.max_by(F.struct(*values), F.col("ordinal")).alias(alias)
    )


def _word(words: Sequence[str]) -> str:
    """Pattern for exactly one of the words."""
    return f"^({'|'.join(words)})$"


def _start(words: Sequence[str]) -> str:
    return f"^({'|'.join(words)})"


def looks_administrative(low: Column) -> Column:
    """Whether a folded command name reads as administration."""
    return low.rlike(_word(fixed.ADMIN_COMMANDS)) | low.rlike("|".join(fixed.ADMIN_KEYWORDS)) | low.rlike(_start(fixed.ADMIN_PREFIXES))


def fallback(kind: Column, low: Column, platforms: Platforms = Platforms()) -> Column:
    """Scope, complexity, reason, action and source where no rule matches.

    Takes the folded type and name.
    """

    def verdict(scope: str, complexity: Column | str, reason: str, action: Column | str, source: str = "heuristic_command") -> Column:
        fields = {"scope": scope, "complexity": complexity, "reason": platforms.say(reason), "action": action, "source": source}
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])

    blocker = low.rlike(_word(fixed.BLOCKER_COMMANDS))
    by_command = (
        F.when(low.rlike(_word(fixed.NON_CORE_COMMANDS)), verdict("ignore", "Ignore", fixed.REASON_NON_CORE, "exclude_from_scope"))
        .when(
            low.rlike(_word(fixed.OBJECT_MANAGEMENT_COMMANDS)),
            verdict("likely_admin", "Ignore", fixed.REASON_OBJECT_MANAGEMENT, "exclude_from_scope"),
        )
        .when(low.rlike(_word(fixed.LOW_COMMANDS)), verdict("application_api", "Low", fixed.REASON_LOW, "direct_use"))
        .when(low.rlike(_word(fixed.MEDIUM_COMMANDS)), verdict("application_api", "Medium", fixed.REASON_MEDIUM, "verify_semantics"))
        .when(
            low.rlike(_word(fixed.HIGH_COMMANDS)),
            verdict(
                "application_api",
                F.when(blocker, "Blocker").otherwise("High"),
                fixed.REASON_HIGH,
                F.when(blocker, "migration_blocker_review").otherwise("rewrite_aggregation"),
            ),
        )
        .when(looks_administrative(low), verdict("ignore", "Ignore", fixed.REASON_ADMIN, "exclude_from_scope"))
        .when(low.startswith("list"), verdict("likely_admin", "Ignore", fixed.REASON_LIST, "exclude_from_scope"))
        .when(
            low.rlike(_start(fixed.SECURITY_PREFIXES)),
            verdict("likely_admin", "Ignore", fixed.REASON_SECURITY, "exclude_from_scope"),
        )
        .otherwise(verdict("application_api", "Medium", fixed.REASON_UNCLASSIFIED, "manual_assessment"))
    )
    return F.when(kind == "command", by_command).otherwise(
        verdict("application_api", "Medium", fixed.REASON_NO_RULE, "manual_assessment", "fallback")
    )


def match_rules(usage: DataFrame, rules: DataFrame, platforms: Platforms = Platforms()) -> DataFrame:
    """Add the default assessment: from the last matching rule, else the fallback."""
    keyed = usage.withColumns(
        {
            "_type": match_key("feature_type"),
            "_name": match_key("feature_name"),
            "_status": or_default("target_support_status", "Unknown"),
        }
    )
    joined = keyed.join(last_by_feature(rules, "_rule"), ["_type", "_name"], "left")
    matched = F.col("_rule").isNotNull()
    joined = joined.withColumn("_else", fallback(F.col("_type"), F.col("_name"), platforms))

    def pick(rule: str, default: str, otherwise: Column) -> Column:
        return F.when(matched, or_default(f"_rule.{rule}", default)).otherwise(otherwise)

    return joined.withColumns(
        {
            "default_scope": pick("migration_scope", "application_api", F.col("_else.scope")),
            "scope_confidence": pick("scope_confidence", "medium", F.lit("low")),
            "needs_review": F.when(matched, F.col("_rule.needs_review")).otherwise(True),
            "default_complexity": pick("default_complexity", "Medium", F.col("_else.complexity")),
            "complexity_reason": F.when(matched, squash("_rule.complexity_reason")).otherwise(F.col("_else.reason")),
            "recommended_action": pick("recommended_action", "manual_assessment", F.col("_else.action")),
            "review_priority": pick("review_priority", "P1", F.lit("P1")),
            "rule_source": F.when(matched, "baseline").otherwise(F.col("_else.source")),
        }
    )


def adjust_for_support(
    scope: Column, complexity: Column, status: Column, kind: Column, low: Column, platforms: Platforms = Platforms()
) -> Column:
    """Struct (complexity, reason) once the support status is known.

    Takes the folded type and name, and a status without gaps.
    """
    blocker = F.lit(False)
    for candidate, name in fixed.BLOCKER_CANDIDATES:
        blocker = blocker | ((kind == candidate) & (low == name.lower()))

    def verdict(value: Column, reason: str) -> Column:
        return F.struct(value.alias("complexity"), F.lit(platforms.say(reason)).alias("reason"))

    def at_least(floor: str) -> Column:
        return higher(complexity, F.lit(floor), fixed.COMPLEXITY)

    return (
        F.when(scope.isin("ignore", "likely_admin"), verdict(F.lit("Ignore"), fixed.ADJUST_EXCLUDED))
        .when(scope != "application_api", verdict(complexity, ""))
        .when(status == "Supported", verdict(lower_of(complexity, F.lit("Low"), fixed.COMPLEXITY), fixed.ADJUST_SUPPORTED))
        .when((status == "Not Supported") & blocker, verdict(at_least("Blocker"), fixed.ADJUST_BLOCKER))
        .when(status == "Not Supported", verdict(at_least("High"), fixed.ADJUST_UNSUPPORTED))
        .when(status == "Partially Supported", verdict(at_least("Medium"), fixed.ADJUST_PARTIAL))
        .when(status == "Unknown", verdict(at_least("Medium"), fixed.ADJUST_UNKNOWN))
        .otherwise(verdict(complexity, ""))
    )


def apply_overrides(assessed: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Each non-blank field of the last matching override replaces its value."""
    if overrides is None:
        return assessed.withColumns({"override_applied": F.lit(False), "effective_scope": F.col("default_scope"), "effective_complexity": F.col("_adjusted.complexity")})
    joined = assessed.join(last_by_feature(overrides, "_override"), ["_type", "_name"], "left")
    fields = {
        "effective_scope": ("override_scope", "default_scope"),
        "effective_complexity": ("override_complexity", "_adjusted.complexity"),
        "complexity_reason": ("override_reason", "complexity_reason"),
        "recommended_action": ("override_action", "recommended_action"),
    }
    return joined.withColumns(
        {name: or_default(f"_override.{field}", F.col(base)) for name, (field, base) in fields.items()}
        | {"override_applied": F.col("_override").isNotNull()}
    )


def necessity(scope: Column) -> Column:
    return lookup(scope, fixed.NECESSITY, "Required")


def necessity_reason(scope: Column, feature_name: Column) -> Column:
    name = or_default(feature_name, "this feature")
    return (
        F.when(scope == "application_api", F.format_string(fixed.NECESSITY_REQUIRED, name))
        .when(scope == "likely_admin", F.format_string(fixed.NECESSITY_CONDITIONAL, name))
        .otherwise(F.format_string(fixed.NECESSITY_OUTSIDE, name))
    )


def explanation(
    feature_type: Column,
    feature_name: Column,
    low: Column,
    scope: Column,
    complexity: Column,
    status: Column,
    usage_count: Column,
    platforms: Platforms = Platforms(),
) -> Column:
    """Why a feature has its complexity; `low` is its folded name."""
    name = squash(feature_name)
    kind = or_default(feature_type, platforms.source)
    command = squash(feature_type) == "command"
    described = (
        F.when(command & low.rlike(_word(fixed.LOW_COMMANDS)), fixed.CLASS_LOW)
        .when(command & low.rlike(_word(fixed.MEDIUM_COMMANDS)), fixed.CLASS_MEDIUM)
        .when(command & low.rlike(_word(fixed.HIGH_COMMANDS)), fixed.CLASS_HIGH)
        .otherwise(F.format_string(fixed.CLASS_OTHER, kind))
    )
    count = F.coalesce(usage_count, F.lit(0))
    observed = F.when(count > 0, F.format_string(fixed.EXPLAIN_USAGE, count)).otherwise("")

    def graded(text: str) -> Column:
        return F.concat(F.format_string(platforms.say(text), name, described, complexity), observed)

    unknown = F.concat(F.format_string(platforms.say(fixed.EXPLAIN_UNKNOWN), name, described), observed)
    return (
        F.when(
            scope.isin("ignore", "likely_admin"),
            F.format_string(platforms.say(fixed.EXPLAIN_EXCLUDED), name, kind),
        )
        .when(status == "Not Supported", graded(fixed.EXPLAIN_UNSUPPORTED))
        .when(status == "Partially Supported", graded(fixed.EXPLAIN_PARTIAL))
        .when(status == "Supported", graded(fixed.EXPLAIN_SUPPORTED))
        .otherwise(unknown)
    )


def priority(complexity: Column, usage_count: Column, max_duration_ms: Column) -> Column:
    """Struct (priority, reason) from complexity, usage and latency."""
    level = complexity
    used = F.coalesce(usage_count, F.lit(0))
    slow = F.coalesce(max_duration_ms, F.lit(0)) >= fixed.PRIORITY_SLOW_MS

    def verdict(value: str, reason: str) -> Column:
        return F.struct(F.lit(value).alias("priority"), F.lit(reason).alias("reason"))

    return (
        F.when(level == "Blocker", verdict("Critical", fixed.PRIORITY_BLOCKER))
        .when((level == "High") & ((used >= fixed.PRIORITY_HIGH_USAGE) | slow), verdict("Critical", fixed.PRIORITY_HIGH_HOT))
        .when(level == "High", verdict("High", fixed.PRIORITY_HIGH))
        .when((level == "Medium") & ((used >= fixed.PRIORITY_MEDIUM_USAGE) | slow), verdict("High", fixed.PRIORITY_MEDIUM_HOT))
        .when(level == "Medium", verdict("Medium", fixed.PRIORITY_MEDIUM))
        .when((level == "Low") & (used >= fixed.PRIORITY_LOW_USAGE), verdict("Medium", fixed.PRIORITY_LOW_HOT))
        .when(level == "Low", verdict("Low", fixed.PRIORITY_LOW))
        .otherwise(verdict("Low", fixed.PRIORITY_OUTSIDE))
    )


def assess(
    usage: DataFrame,
    rules: DataFrame,
    overrides: DataFrame | None = None,
    rules_version: str = "",
    platforms: Platforms = Platforms(),
) -> DataFrame:
    """Usage with support status to usage with its full assessment.

    Overrides come after the support adjustment: one that moves a feature
    into scope leaves its complexity alone unless it sets that as well.
    """
    c = F.col
    adjusted = adjust_for_support(c("default_scope"), c("default_complexity"), c("_status"), c("_type"), c("_name"), platforms)
    ruled = match_rules(usage, rules, platforms).withColumn("_adjusted", adjusted)
    final = apply_overrides(ruled, overrides).withColumns(
        {
            "default_migration_necessity": necessity(c("default_scope")),
            "effective_migration_necessity": necessity(c("effective_scope")),
            "migration_necessity_reason": necessity_reason(c("effective_scope"), c("feature_name")),
            "complexity_explanation": explanation(
                c("feature_type"),
                c("feature_name"),
                c("_name"),
                c("effective_scope"),
                c("effective_complexity"),
                c("_status"),
                c("usage_count"),
                platforms,
            ),
            "_priority": priority(c("effective_complexity"), c("usage_count"), c("max_duration_ms")),
            "rules_version": F.lit(rules_version),
        }
    )
    parts = {
        "complexity_adjustment_reason": "_adjusted.reason",
        "migration_priority": "_priority.priority",
        "priority_reason": "_priority.reason",
    }
    return final.select(*usage.columns, *[c(parts.get(name, name)).alias(name) for name in ASSESSMENT_COLUMNS])


def complexity_rank(column: str = "effective_complexity") -> Column:
    return rank_of(column, fixed.COMPLEXITY)


def priority_rank(column: str = "migration_priority") -> Column:
    return rank_of(column, fixed.PRIORITY)


def _place() -> list[Column]:
    """Where a feature is used: the rest of the key, so that no tie is left open."""
    return [F.asc(c) for c in ("command_name", "op_type", "database", "collection")]


def assessed_order() -> list[Column]:
    """Hardest first, then most urgent, most used and by name."""
    return [complexity_rank().desc(), priority_rank().desc(), F.desc("usage_count"), F.asc("feature_type"), F.asc("feature_name"), *_place()]


def is_hotspot(require_scope: bool = True) -> Column:
    """Hard features, and medium ones that are used a lot.

    The report view counts them without looking at scope.
    """
    often = F.coalesce(F.col("usage_count"), F.lit(0)) >= fixed.HOTSPOT_USAGE
    hard = F.col("effective_complexity").isin("High", "Blocker") | ((F.col("effective_complexity") == "Medium") & often)
    return (F.col("effective_scope") == "application_api") & hard if require_scope else hard


def hotspots(assessed: DataFrame) -> DataFrame:
    return assessed.filter(is_hotspot())


def hotspot_order() -> list[Column]:
    return [
        priority_rank().desc(),
        complexity_rank().desc(),
        F.desc("usage_count"),
        F.desc_nulls_last("max_duration_ms"),
        F.asc("feature_type"),
        F.asc("feature_name"),
        *_place(),
    ]


def excluded(assessed: DataFrame) -> DataFrame:
    """Features outside the application's migration scope."""
    return assessed.filter(F.col("effective_scope").isin("ignore", "likely_admin"))


def excluded_order() -> list[Column]:
    return [F.desc("usage_count"), F.asc("command_name"), F.asc("feature_name")]


def run_quality(assessed: DataFrame) -> DataFrame:
    """Rule coverage and counts that qualify one assessment run."""
    rows, unclassified = F.count(F.lit(1)), F.count_if(F.col("rule_source") == "fallback")
    return assessed.agg(
        rows.alias("usage_row_count"),
        F.round((rows - unclassified) / F.greatest(rows, F.lit(1)), 4).alias("rules_coverage_rate"),
        unclassified.alias("unclassified_feature_count"),
        F.count_if("override_applied").alias("override_count"),
        F.count_if(blank("target_support_status") == "Unknown").alias("unmapped_feature_count"),
        F.count_if(F.col("database") == fixed.INSTANCE_LEVEL).alias("instance_level_usage_row_count"),
    )
