"""Check SQL: the registered queries written again for DuckDB.

Shared steps are named common table expressions; `check` puts together the
ones a query needs. Nothing here is derived from the Spark expressions.
"""

from __future__ import annotations

import csv
import io
import re

from portlens import fixed
from portlens.cases import inputs
from portlens.rule_table import RULES_CSV


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + f", {n})" for n, row in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) t({names}, ordinal)"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    """White space as Unicode sees it; three marks are dropped."""
    dropped = rf"regexp_replace(coalesce({x}, ''), '[\x{{00C2}}\x{{200B}}\x{{FEFF}}]', '', 'g')"
    return rf"trim(regexp_replace({dropped}, '[\s\x{{000B}}\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def raw_status(x: str) -> str:
    low = f"trim(lower(coalesce({x}, '')))"
    return (
        f"CASE WHEN {low} LIKE '%no-op%' THEN 'Supported' WHEN {low} LIKE '%not supported%' OR {low} LIKE '%unsupported%' THEN 'Not Supported' "
        f"WHEN {low} IN ('no', 'n/a', 'na') OR {low} LIKE '%not applicable%' THEN 'Not Supported' "
        f"WHEN {low} LIKE '%partial%' OR {low} LIKE '%limited%' THEN 'Partially Supported' "
        f"WHEN {low} LIKE '%supported%' OR {low} LIKE '%yes%' OR {low} LIKE '%full%' THEN 'Supported' "
        f"WHEN regexp_matches({low}, '[0-9]') OR {low} LIKE '%always%' THEN 'Supported' ELSE 'Other' END"
    )


def versions(x: str) -> str:
    found = rf"list_transform(regexp_extract_all({x}, '(?i)\b(\d+\s*(?:ai|c))\b', 1), lambda v: lower(regexp_replace(v, '\s', '', 'g')))"
    # list_distinct does not keep the order of appearance.
    return f"list_filter({found}, lambda v, i: list_position({found}, v) = i)"


def rank(v: str) -> str:
    return f"(TRY_CAST(regexp_extract({v}, '^([0-9]+)(ai|c)$', 1) AS BIGINT) * 2 + CASE WHEN {v} LIKE '%ai' THEN 1 ELSE 0 END)"


def effective(since: str, version: str, mode: str) -> str:
    """Status for a literal or column scenario; `any` and blank are open."""
    text = f"trim(coalesce({since}, ''))"
    low = f"lower({text})"
    named = versions(text)
    wanted = f"CASE WHEN {version} IN ('', 'any') THEN (CASE WHEN len({named}) > 0 THEN {named} ELSE ['19c', '26ai'] END) ELSE [lower(replace({version}, ' ', ''))] END"
    modes = f"CASE WHEN {mode} = 'any' THEN ['op', 'no-op'] ELSE [{mode}] END"
    inner = f"flatten(list_transform(regexp_extract_all({text}, '\\(([^)]*)\\)', 1), lambda s: {versions('s')}))"
    noop = f"CASE WHEN {low} LIKE '%no-op%' THEN {inner} ELSE [] END"
    base = versions(f"regexp_replace({text}, '\\([^)]*\\)', ' ', 'g')")
    first = f"list_min(list_transform({base}, lambda b: {rank('b')}))"
    ok = (
        f"CASE WHEN {low} = 'no-op' THEN m = 'no-op' AND v IN ('19c', '26ai') "
        f"ELSE (m = 'no-op' AND list_contains({noop}, v)) OR coalesce({rank('v')} >= {first}, false) END"
    )
    hits = f"list_filter({wanted}, lambda v: len(list_filter({modes}, lambda m: {ok})) > 0)"
    return (
        f"CASE WHEN {text} = '' THEN 'Unknown' "
        f"WHEN {low} LIKE '%not supported%' OR {low} LIKE '%unsupported%' OR {low} LIKE '%not applicable%' OR {low} IN ('no', 'n/a', 'na') THEN 'Not Supported' "
        f"WHEN len({hits}) > 0 THEN 'Supported' ELSE 'Not Supported' END"
    )


def complexity_rank(x: str) -> str:
    return f"CASE {x} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Blocker' THEN 4 ELSE 0 END"


def priority_rank(x: str) -> str:
    return f"CASE {x} WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 ELSE 0 END"


def pct(part: str, total: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / greatest({total}, 1) * 100, 2)"


def percent_text(x: str) -> str:
    return f"printf('%.1f', {x})"


def sorted_list(x: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {x}) FILTER (WHERE trim(coalesce({x}, '')) <> '')), ', '), '')"


def fallback(kind: str, name: str) -> dict[str, str]:
    """Scope, complexity, reason, action and source of the no-rule verdict."""
    low = f"lower({squash(name)})"
    admin = f"({low} IN {_list(fixed.ADMIN_COMMANDS)}"
    admin += "".join(f" OR contains({low}, '{k}')" for k in fixed.ADMIN_KEYWORDS)
    admin += "".join(f" OR starts_with({low}, '{k}')" for k in fixed.ADMIN_PREFIXES) + ")"
    security = "(" + " OR ".join(f"starts_with({low}, '{k}')" for k in ("create", "drop", "grant", "revoke", "updateuser", "updaterole")) + ")"
    say = lambda t: t.replace("{source}", "source").replace("{target}", "the target platform").replace("{vendor}", "Target")
    branches = [
        (f"{low} IN {_list(fixed.NON_CORE_COMMANDS)}", "ignore", "Ignore", fixed.REASON_NON_CORE, "exclude_from_scope"),
        (f"{low} IN {_list(fixed.OBJECT_MANAGEMENT_COMMANDS)}", "likely_admin", "Ignore", fixed.REASON_OBJECT_MANAGEMENT, "exclude_from_scope"),
        (f"{low} IN {_list(fixed.LOW_COMMANDS)}", "application_api", "Low", fixed.REASON_LOW, "direct_use"),
        (f"{low} IN {_list(fixed.MEDIUM_COMMANDS)}", "application_api", "Medium", fixed.REASON_MEDIUM, "verify_semantics"),
        (f"{low} = 'mapreduce'", "application_api", "Blocker", fixed.REASON_HIGH, "migration_blocker_review"),
        (f"{low} = 'aggregate'", "application_api", "High", fixed.REASON_HIGH, "rewrite_aggregation"),
        (admin, "ignore", "Ignore", fixed.REASON_ADMIN, "exclude_from_scope"),
        (f"starts_with({low}, 'list')", "likely_admin", "Ignore", fixed.REASON_LIST, "exclude_from_scope"),
        (security, "likely_admin", "Ignore", fixed.REASON_SECURITY, "exclude_from_scope"),
        ("true", "application_api", "Medium", fixed.REASON_UNCLASSIFIED, "manual_assessment"),
    ]
    command = f"lower({squash(kind)}) = 'command'"
    other = ("application_api", "Medium", fixed.REASON_NO_RULE, "manual_assessment")
    result = {}
    for i, field in enumerate(("scope", "complexity", "reason", "action")):
        arms = " ".join(f"WHEN {b[0]} THEN '{say(b[i + 1])}'" for b in branches)
        result[field] = f"CASE WHEN {command} THEN (CASE {arms} END) ELSE '{say(other[i])}' END"
    result["source"] = f"CASE WHEN {command} THEN 'heuristic_command' ELSE 'fallback' END"
    return result


KNOWN = "['findAndModify', 'find', 'aggregate', 'insert', 'update', 'delete', 'distinct', 'count', 'createIndexes', 'dropIndexes', 'listIndexes']"
KNOWN_LEGACY = "['find', 'aggregate', 'insert', 'update', 'delete', 'findAndModify', 'distinct', 'count', 'createIndexes', 'dropIndexes', 'listIndexes']"


def keys(x: str) -> str:
    return f"(CASE WHEN json_valid({x}) AND json_type({x}) = 'OBJECT' THEN json_keys({x}) END)"


def document(legacy: bool) -> str:
    """Command document of a placed record."""
    q = "(CASE WHEN json_valid(query) AND json_type(query) = 'OBJECT' THEN query ELSE '{}' END)"
    u = "(CASE WHEN json_valid(updateobj) AND json_type(updateobj) = 'OBJECT' THEN updateobj ELSE '{}' END)"
    given = "coalesce(len(" + keys("command") + ") > 0, false)"
    bare = f"list_contains({keys('command')}, 'q') AND NOT list_has_any({keys('command')}, {KNOWN})"
    upd = lambda item: "'{\"update\":\"' || collection_name || '\",\"updates\":[' || " + item + " || ']}'"
    dele = lambda item: "'{\"delete\":\"' || collection_name || '\",\"deletes\":[' || " + item + " || ']}'"
    wrapped = "" if legacy else f"WHEN {given} AND {bare} AND op = 'update' THEN {upd('command')} WHEN {given} AND {bare} AND op = 'remove' THEN {dele('command')} "
    pair = "'{\"q\":' || " + q + " || ',\"u\":' || " + u + " || '}'"
    only = "'{\"q\":' || " + q + " || '}'"
    return (
        f"CASE {wrapped}WHEN {given} THEN command "
        f"WHEN op = 'query' AND list_has_any(json_keys({q}), ['find', 'aggregate', 'count', 'distinct']) THEN {q} "
        f"WHEN op = 'query' THEN '{{\"find\":\"' || collection_name || '\",\"filter\":' || {q} || '}}' "
        f"WHEN op = 'update' THEN {upd(pair)} WHEN op = 'remove' THEN {dele(only)} "
        f"WHEN op = 'insert' THEN '{{\"insert\":\"' || collection_name || '\"}}' WHEN {q} <> '{{}}' THEN {q} ELSE {u} END"
    )


def detected(doc: str, known: str) -> str:
    named = f"list_filter({known}, lambda k: list_contains(json_keys({doc}), k))[1]"
    other = f"list_filter(json_keys({doc}), lambda k: trim(k) <> '' AND trim(k) NOT IN {_list(fixed.COMMAND_METADATA_KEYS)} AND NOT starts_with(trim(k), '$'))[1]"
    by_op = "CASE op WHEN 'query' THEN 'find' WHEN 'insert' THEN 'insert' WHEN 'update' THEN 'update' WHEN 'remove' THEN 'delete' ELSE 'unknown' END"
    return f"coalesce({named}, {other}, {by_op})"


def _events(legacy: bool) -> str:
    doc = document(legacy)
    name = detected("command_doc", KNOWN_LEGACY if legacy else KNOWN)
    return (
        f"SELECT *, {name} AS command_name FROM (SELECT event_key, ts, db_name, collection_name, op, {doc} AS command_doc, millis AS duration_ms, "
        "docsExamined AS docs_examined, keysExamined AS keys_examined, nreturned, errCode AS err_code, nullif(coalesce(errMsg, ''), '') AS err_msg FROM scanned)"
    )


_REL = "replace(t.fullkey, '\"', '')"
_KIND = "CASE WHEN contains(t.path, '\"$expr\"') THEN 'expression' ELSE 'operator' END"


def _stage_level(n: int) -> str:
    """Stages of the pipelines at nesting level `n`."""
    return (
        f"SELECT event_key, i AS position, s AS stage, json_keys(s)[1] AS name FROM (SELECT event_key, unnest(range(len(l))) AS i, unnest(l) AS s "
        f"FROM (SELECT event_key, json_extract(pipeline, '$[*]') AS l FROM pipelines{n})) WHERE json_type(s) = 'OBJECT' AND len(json_keys(s)) > 0"
    )


def _nested(n: int) -> str:
    """Pipelines nested in the stages of level `n`."""
    return (
        f"SELECT event_key, json_extract(stage, '$.\"$lookup\".pipeline') AS pipeline FROM stages{n} WHERE name = '$lookup' AND json_type(json_extract(stage, '$.\"$lookup\".pipeline')) = 'ARRAY' "
        f"UNION ALL SELECT s.event_key, t.value AS pipeline FROM stages{n} s, json_each(s.stage, '$.\"$facet\"') t WHERE s.name = '$facet' AND t.type = 'ARRAY'"
    )


STEPS: dict[str, str] = {
    "profile": inputs.PROFILE,
    "log_lines": inputs.LOG_LINES,
    "counters": inputs.COUNTERS,
    "inventory": inputs.INVENTORY,
    "support": inputs.SUPPORT,
    "catalog": inputs.CATALOG,
    "supplemental": inputs.SUPPLEMENTAL,
    "support_pages": inputs.SUPPORT_PAGES,
    "reference_pages": inputs.REFERENCE_PAGES,
    "versioned_pages": inputs.VERSIONED_PAGES,
    "rules": _values([tuple(r.values()) for r in csv.DictReader(io.StringIO(RULES_CSV))], RULES_CSV.splitlines()[0]),
    "overrides": _values(inputs.OVERRIDES, "feature_type, feature_name, override_scope, override_complexity, override_reason, override_action, enabled"),
    "placed": "SELECT *, CASE WHEN contains(ns, '.') AND split_part(ns, '.', 1) <> '' THEN split_part(ns, '.', 1) ELSE coalesce(db, '') END AS db_name, "
    "CASE WHEN contains(ns, '.') THEN substr(ns, strpos(ns, '.') + 1) ELSE '' END AS collection_name FROM profile",
    "scanned": "SELECT * FROM placed WHERE collection_name <> 'system.profile' AND lower(db_name) NOT IN ('admin', 'config', 'local')",
    "events_table": _events(False),
    "legacy_events": _events(True),
    "pipelines0": "SELECT event_key, json_extract(command_doc, '$.pipeline') AS pipeline FROM events_table WHERE command_name = 'aggregate'",
    "stages0": _stage_level(0),
    "pipelines1": _nested(0),
    "stages1": _stage_level(1),
    "pipelines2": _nested(1),
    "stages2": _stage_level(2),
    "pipelines3": _nested(2),
    "stages3": _stage_level(3),
    "all_stages": "SELECT *, 0 AS depth FROM stages0 UNION ALL SELECT *, 1 FROM stages1 UNION ALL SELECT *, 2 FROM stages2 UNION ALL SELECT *, 3 FROM stages3",
    "found": f"""
      SELECT event_key, 'command' AS feature_type, command_name AS feature_name, 'command.' || command_name AS sample_path,
        coalesce(CAST(json_extract(command_doc, '$.' || command_name) AS VARCHAR), 'null') AS sample_value
      FROM events_table WHERE list_contains({KNOWN}, command_name)
      UNION ALL SELECT e.event_key, {_KIND}, t.key, 'command' || substr({_REL}, 2), CAST(t.value AS VARCHAR)
      FROM events_table e, json_tree(e.command_doc) t
      WHERE starts_with(t.key, '$') AND ((e.command_name = 'find' AND regexp_matches(t.path, '^\\$\\.(filter|projection)([.\\[]|$)'))
        OR (e.command_name = 'findAndModify' AND regexp_matches(t.path, '^\\$\\.(query|update)([.\\[]|$)'))
        OR (e.command_name = 'update' AND regexp_matches(t.path, '^\\$\\.updates\\[[0-9]+\\]\\.(q|u)([.\\[]|$)'))
        OR (e.command_name = 'delete' AND regexp_matches(t.path, '^\\$\\.deletes\\[[0-9]+\\]\\.q([.\\[]|$)')))
      UNION ALL SELECT event_key, 'stage', name, 'command.pipeline[' || position || '].' || name, CAST(json_extract(stage, '$."' || name || '"') AS VARCHAR)
      FROM all_stages WHERE starts_with(name, '$')
      UNION ALL SELECT s.event_key, CASE WHEN s.name <> '$match' OR contains(t.path, '"$expr"') THEN 'expression' ELSE 'operator' END, t.key,
        'command.pipeline[' || s.position || ']' || substr({_REL}, 2), CAST(t.value AS VARCHAR)
      FROM all_stages s, json_tree(s.stage) t
      WHERE starts_with(t.key, '$') AND t.path <> '$' AND t.id > 0
        AND NOT (s.name IN ('$lookup', '$facet') AND json_type(json_extract(s.stage, '$."' || s.name || '"')) = 'OBJECT')""",
    "feats": "SELECT f.*, e.ts, e.duration_ms, e.command_name, e.op AS op_type, e.db_name AS database, e.collection_name AS collection FROM found f JOIN events_table e ON f.event_key = e.event_key",
    "usage_samples": "SELECT *, row_number() OVER (PARTITION BY feature_type, feature_name, command_name, op_type, database, collection ORDER BY ts DESC, event_key, sample_path, sample_value) AS rn FROM feats",
    "usage_rows": "SELECT feature_type, feature_name, command_name, op_type, database, collection, count(*) AS usage_count, min(ts) AS first_seen, max(ts) AS last_seen, "
    "max(duration_ms) AS max_duration_ms, max(sample_path) FILTER (WHERE rn = 1) AS sample_path, max(sample_value) FILTER (WHERE rn = 1) AS sample_value "
    "FROM usage_samples GROUP BY ALL",
    "counts": "SELECT feature_type, feature_name, command_name, op_type, database, collection, count(*) AS usage_count, min(ts) AS first_seen, max(ts) AS last_seen, "
    "max(duration_ms) AS max_duration_ms FROM feats GROUP BY ALL",
    "support_keys": f"""SELECT kind, lower({squash('name')}) AS folded, row_id, {squash('support_since')} AS since, section, feature,
        CASE WHEN {squash('support_since')} <> '' THEN {raw_status(squash('support_since'))} ELSE coalesce(nullif({squash('normalized_status')}, ''), 'Unknown') END AS status
      FROM (SELECT *, coalesce(nullif(trim(command), ''), nullif(trim(stage), ''), nullif(trim(operator), '')) AS feature FROM support) s,
        LATERAL (SELECT 'command' AS kind, s.command AS name UNION ALL SELECT 'stage', s.stage UNION ALL SELECT 'operator', s.operator) k
      WHERE trim(name) <> ''""",
    "support_first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, folded ORDER BY row_id) AS rn FROM support_keys) WHERE rn = 1",
    "mapped": f"""SELECT u.*, coalesce(s.status, 'Unknown') AS target_support_status, coalesce(s.since, '') AS target_support_since,
        coalesce({squash('s.section')}, '') AS target_category, coalesce(s.feature, '') AS target_feature
      FROM counts u LEFT JOIN support_first s ON s.kind = CASE WHEN u.feature_type = 'expression' THEN 'operator' ELSE u.feature_type END AND s.folded = lower(u.feature_name)""",
    "rule_last": f"SELECT *, lower({squash('feature_type')}) AS kt, lower({squash('feature_name')}) AS kn, row_number() OVER (PARTITION BY lower({squash('feature_type')}), lower({squash('feature_name')}) ORDER BY ordinal DESC) AS rn FROM rules WHERE lower(trim(enabled)) IN ('1', 'true', 'yes', 'y')",
    "override_last": f"SELECT *, lower({squash('feature_type')}) AS kt, lower({squash('feature_name')}) AS kn, row_number() OVER (PARTITION BY lower({squash('feature_type')}), lower({squash('feature_name')}) ORDER BY ordinal DESC) AS rn FROM overrides WHERE lower(trim(enabled)) IN ('1', 'true', 'yes', 'y')",
}


def ruled(source: str) -> str:
    """Rows of `source` with their default assessment."""
    f = fallback("u.feature_type", "u.feature_name")
    pick = lambda rule, default, other: f"CASE WHEN r.ordinal IS NOT NULL THEN coalesce(nullif({squash('r.' + rule)}, ''), '{default}') ELSE {other} END"
    return (
        f"SELECT u.*, {pick('migration_scope', 'application_api', f['scope'])} AS default_scope, {pick('scope_confidence', 'medium', chr(39) + 'low' + chr(39))} AS scope_confidence, "
        f"CASE WHEN r.ordinal IS NOT NULL THEN lower(r.needs_review) IN ('1', 'true', 'yes', 'y') ELSE true END AS needs_review, "
        f"{pick('default_complexity', 'Medium', f['complexity'])} AS default_complexity, "
        f"CASE WHEN r.ordinal IS NOT NULL THEN {squash('r.complexity_reason')} ELSE {f['reason']} END AS rule_reason, "
        f"{pick('recommended_action', 'manual_assessment', f['action'])} AS rule_action, {pick('review_priority', 'P1', chr(39) + 'P1' + chr(39))} AS review_priority, "
        f"CASE WHEN r.ordinal IS NOT NULL THEN 'baseline' ELSE {f['source']} END AS rule_source "
        f"FROM {source} u LEFT JOIN rule_last r ON r.rn = 1 AND r.kt = lower({squash('u.feature_type')}) AND r.kn = lower({squash('u.feature_name')})"
    )


def adjusted(source: str, overrides: bool = True) -> str:
    """Support adjustment, then overrides."""
    st = f"coalesce(nullif({squash('target_support_status')}, ''), 'Unknown')"
    cr = complexity_rank("default_complexity")
    blocker = "lower(feature_type) = 'stage' AND lower(feature_name) = '$graphlookup'"
    at_least = lambda level, n: f"CASE WHEN {cr} >= {n} THEN default_complexity ELSE '{level}' END"
    app = "default_scope = 'application_api'"
    complexity = (
        f"CASE WHEN default_scope IN ('ignore', 'likely_admin') THEN 'Ignore' WHEN NOT {app} THEN default_complexity "
        f"WHEN {st} = 'Supported' THEN CASE WHEN {cr} <= 1 THEN default_complexity ELSE 'Low' END "
        f"WHEN {st} = 'Not Supported' AND {blocker} THEN 'Blocker' WHEN {st} = 'Not Supported' THEN {at_least('High', 3)} "
        f"WHEN {st} IN ('Partially Supported', 'Unknown') THEN {at_least('Medium', 2)} ELSE default_complexity END"
    )
    reason = (
        f"CASE WHEN default_scope IN ('ignore', 'likely_admin') THEN 'Administrative or operational item is excluded from application migration scope.' WHEN NOT {app} THEN '' "
        f"WHEN {st} = 'Supported' THEN 'Target support status is Supported, so application code change is expected to be minimal.' "
        f"WHEN {st} = 'Not Supported' AND {blocker} THEN 'Target support status is Not Supported for a blocker-candidate API.' "
        f"WHEN {st} = 'Not Supported' THEN 'Target support status is Not Supported.' WHEN {st} = 'Partially Supported' THEN 'Target support status is Partially Supported.' "
        f"WHEN {st} = 'Unknown' THEN 'Target support status is Unknown, requiring manual validation.' ELSE '' END"
    )
    over = lambda field, value: f"coalesce(nullif({squash('o.' + field)}, ''), {value})" if overrides else value
    applied = "o.ordinal IS NOT NULL" if overrides else "false"
    join = f"LEFT JOIN override_last o ON o.rn = 1 AND o.kt = lower({squash('a.feature_type')}) AND o.kn = lower({squash('a.feature_name')})" if overrides else ""
    return (
        f"SELECT a.* EXCLUDE (rule_reason, rule_action), {over('override_scope', 'a.default_scope')} AS effective_scope, {over('override_complexity', 'a.adjusted_complexity')} AS effective_complexity, "
        f"{over('override_reason', 'a.rule_reason')} AS complexity_reason, {over('override_action', 'a.rule_action')} AS recommended_action, {applied} AS override_applied "
        f"FROM (SELECT *, {complexity} AS adjusted_complexity, {reason} AS complexity_adjustment_reason FROM {source}) a {join}"
    )


def necessity(scope: str) -> str:
    return f"CASE {scope} WHEN 'likely_admin' THEN 'Conditional' WHEN 'ignore' THEN 'Unnecessary' ELSE 'Required' END"


def judged(source: str) -> str:
    """Necessity, explanation and priority."""
    low = f"lower({squash('feature_name')})"
    name = "'`' || feature_name || '` '"
    described = (
        f"CASE WHEN feature_type = 'command' AND {low} IN {_list(fixed.LOW_COMMANDS)} THEN 'core application CRUD command' "
        f"WHEN feature_type = 'command' AND {low} IN {_list(fixed.MEDIUM_COMMANDS)} THEN 'application-facing command with semantic differences' "
        f"WHEN feature_type = 'command' AND {low} IN {_list(fixed.HIGH_COMMANDS)} THEN 'application-facing command with complex processing semantics' "
        "ELSE 'application-facing ' || feature_type || ' feature' END"
    )
    seen = "CASE WHEN usage_count > 0 THEN ' It is observed ' || usage_count || ' time(s) in the current workload.' ELSE '' END"
    explanation = (
        f"CASE WHEN effective_scope IN ('ignore', 'likely_admin') THEN {name} || 'is a ' || feature_type || ' feature used mainly for database administration or operations, not for preserving application behavior during migration to the target platform. Its migration complexity is therefore Ignore unless the customer explicitly wants to keep this operational workflow.' "
        f"WHEN target_support_status = 'Not Supported' THEN {name} || 'is a ' || {described} || '. the target platform marks it as Not Supported in the selected target combination, so application migration must redesign or replace this behavior. This drives the complexity to ' || effective_complexity || '.' || {seen} "
        f"WHEN target_support_status = 'Partially Supported' THEN {name} || 'is a ' || {described} || '. the target platform only partially supports it in the selected target combination, so migration requires semantic validation and likely localized rewrite. This results in ' || effective_complexity || ' complexity.' || {seen} "
        f"WHEN target_support_status = 'Supported' THEN {name} || 'is a ' || {described} || ' and is supported by the target platform in the selected target combination. Migration complexity remains ' || effective_complexity || ' because the application behavior is likely portable with limited change.' || {seen} "
        f"ELSE {name} || 'is a ' || {described} || ', but its support status is currently Unknown for the selected target combination. Migration complexity is therefore kept conservative until the feature is reviewed manually.' || {seen} END"
    )
    reason = (
        f"CASE effective_scope WHEN 'application_api' THEN {name} || 'affects application-visible behavior or application-managed objects, so it should be considered part of the migration compatibility scope.' "
        f"WHEN 'likely_admin' THEN {name} || 'is usually operational or tooling-related. Keep it only if the customer explicitly needs the same workflow after migration.' "
        f"ELSE {name} || 'is mainly administrative or diagnostic and is normally outside the application migration scope.' END"
    )
    slow = "coalesce(max_duration_ms, 0) >= 1000"
    arms = [
        ("effective_complexity = 'Blocker'", "Critical", fixed.PRIORITY_BLOCKER),
        (f"effective_complexity = 'High' AND (usage_count >= 10 OR {slow})", "Critical", fixed.PRIORITY_HIGH_HOT),
        ("effective_complexity = 'High'", "High", fixed.PRIORITY_HIGH),
        (f"effective_complexity = 'Medium' AND (usage_count >= 20 OR {slow})", "High", fixed.PRIORITY_MEDIUM_HOT),
        ("effective_complexity = 'Medium'", "Medium", fixed.PRIORITY_MEDIUM),
        ("effective_complexity = 'Low' AND usage_count >= 50", "Medium", fixed.PRIORITY_LOW_HOT),
        ("effective_complexity = 'Low'", "Low", fixed.PRIORITY_LOW),
        ("true", "Low", fixed.PRIORITY_OUTSIDE),
    ]
    level = " ".join(f"WHEN {a[0]} THEN '{a[1]}'" for a in arms)
    why = " ".join(f"WHEN {a[0]} THEN '{a[2]}'" for a in arms)
    return (
        f"SELECT * EXCLUDE (adjusted_complexity), {necessity('default_scope')} AS default_migration_necessity, {necessity('effective_scope')} AS effective_migration_necessity, "
        f"{reason} AS migration_necessity_reason, {explanation} AS complexity_explanation, CASE {level} END AS migration_priority, CASE {why} END AS priority_reason, 'v1.1' AS rules_version FROM {source}"
    )


def rolled(source: str) -> str:
    """API baseline of an assessed table."""
    order = f"-({complexity_rank('effective_complexity')}), -({priority_rank('migration_priority')}), -coalesce(usage_count, 0), feature_type, feature_name, command_name, op_type, database, collection"
    firsts = "default_scope effective_scope default_migration_necessity effective_migration_necessity migration_necessity_reason default_complexity effective_complexity recommended_action complexity_reason complexity_explanation".split()
    first = ", ".join(f"first({c} ORDER BY {order}) AS {c}" for c in firsts)
    return (
        f"SELECT feature_type, feature_name, target_category AS target_section, target_support_since, {sorted_list('command_name')} AS command_contexts, "
        f"CAST(sum(usage_count) AS BIGINT) AS usage_count, {sorted_list('collection')} AS collections, count(DISTINCT database) FILTER (WHERE database <> '') AS database_count, {first}, "
        f"bool_or(override_applied) AS override_applied, {sorted_list('target_support_status')} AS target_support_statuses, "
        f"'' AS override_scope, '' AS override_complexity, '' AS override_action, '' AS override_reason, false AS override_enabled FROM {source} GROUP BY feature_type, feature_name, target_category, target_support_since"
    )


PSEUDO = "'' AS op_type, '' AS database, '' AS collection, CAST(1 AS BIGINT) AS usage_count, '' AS first_seen, '' AS last_seen, CAST(NULL AS BIGINT) AS max_duration_ms, '' AS sample_path, '' AS sample_value"


def support_usage(status: str) -> str:
    return f"""SELECT kind AS feature_type, {squash('name')} AS feature_name, context AS command_name, {PSEUDO}, {status} AS target_support_status, support_since AS target_support_since,
        section AS target_category, source_short_description FROM (SELECT s.*, k.* FROM described_support s,
        LATERAL (SELECT 'command' AS kind, s.command AS name, s.command AS context UNION ALL SELECT 'stage', s.stage, 'aggregate' UNION ALL SELECT 'operator', s.operator, s.command) k WHERE trim(k.name) <> '')"""


STEPS |= {
    "ruled": ruled("mapped"),
    "adjusted": adjusted("ruled"),
    "assessed": judged("adjusted"),
    "baseline": rolled("assessed"),
    # catalogue side
    "entries": f"SELECT ordinal, entity_type, source_group, {squash('name')} AS feature_name, CASE source_group WHEN 'command' THEN 'command' WHEN 'aggregation_stage' THEN 'stage' ELSE 'operator' END AS feature_type, "
    f"{squash('category')} AS category, {squash('short_description')} AS short_description, doc_url, source_page_url FROM catalog_first",
    "catalog_first": "SELECT * EXCLUDE (rn), sha256(name || '|' || source_group || '|' || coalesce(short_description, '') || '|' || doc_url) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, source_group, name ORDER BY ordinal) AS rn FROM catalog) WHERE rn = 1",
    "support_key": f"""SELECT *, CASE WHEN {squash('command')} <> '' THEN 'command' WHEN {squash('stage')} <> '' THEN 'stage' WHEN {squash('operator')} <> '' THEN 'operator' ELSE '' END AS key_type,
        CASE WHEN {squash('command')} <> '' THEN 'command' WHEN {squash('stage')} <> '' THEN 'aggregation_stage' WHEN {squash('operator')} = '' THEN ''
          WHEN contains(lower(section), 'update') THEN 'update_operator' WHEN contains(lower(section), 'projection') THEN 'projection_operator' WHEN contains(lower(section), 'query') THEN 'query_operator' ELSE 'expression_operator' END AS key_group,
        CASE WHEN {squash('command')} <> '' THEN {squash('command')} WHEN {squash('stage')} <> '' THEN {squash('stage')} ELSE {squash('operator')} END AS key_name FROM support""",
    "loose": "SELECT entity_type, name, any_value(short_description) AS short_description, any_value(doc_url) AS doc_url, any_value(category) AS category, any_value(last_synced_at) AS last_synced_at FROM catalog_first GROUP BY entity_type, name HAVING count(*) = 1",
    "described_support": """SELECT s.* EXCLUDE (key_type, key_group, key_name), s.key_type AS source_entity_type, s.key_group AS source_group, s.key_name AS source_name,
        coalesce(CASE WHEN e.name IS NOT NULL THEN e.short_description ELSE l.short_description END, '') AS source_short_description, coalesce(CASE WHEN e.name IS NOT NULL THEN e.doc_url ELSE l.doc_url END, '') AS source_doc_url,
        coalesce(CASE WHEN e.name IS NOT NULL THEN e.category ELSE l.category END, '') AS source_reference_category, coalesce(CASE WHEN e.name IS NOT NULL THEN e.last_synced_at ELSE l.last_synced_at END, '') AS source_last_synced_at
      FROM support_key s LEFT JOIN catalog_first e ON e.entity_type = s.key_type AND e.source_group = s.key_group AND e.name = s.key_name LEFT JOIN loose l ON l.entity_type = s.key_type AND l.name = s.key_name""",
    "documented": """SELECT feature_type, feature_name, array_to_string(list(v ORDER BY o) FILTER (WHERE f = 'g'), ' | ') AS source_group, coalesce(array_to_string(list(v ORDER BY o) FILTER (WHERE f = 'c'), ' | '), '') AS source_category,
        coalesce(first(v ORDER BY o) FILTER (WHERE f = 'd'), '') AS source_short_description, coalesce(first(v ORDER BY o) FILTER (WHERE f = 'u'), '') AS source_doc_url, '8.0' AS source_manual_version, 'reference_docs' AS baseline_source_kind,
        array_to_string(list(v ORDER BY o) FILTER (WHERE f = 'p'), ' | ') AS baseline_source_ref, false AS admin_operational_flag, false AS ignore_candidate_from_source, false AS deprecated_flag, '' AS availability_notes, '' AS aliases_json
      FROM (SELECT feature_type, feature_name, f, v, min(ordinal) AS o FROM entries e, LATERAL (SELECT 'g' AS f, e.source_group AS v UNION ALL SELECT 'c', e.category UNION ALL SELECT 'd', e.short_description UNION ALL SELECT 'u', e.doc_url UNION ALL SELECT 'p', e.source_page_url) k
        WHERE v <> '' AND feature_name <> '' GROUP BY ALL) GROUP BY feature_type, feature_name""",
    "listed": """SELECT source_ref, trim(t.key) AS feature_name, t.value AS payload, coalesce(json_extract(t.value, '$.doc_categories[*]'), []) AS cats FROM supplemental s, json_each(s.document) t
      WHERE t.type = 'OBJECT' AND NOT contains(trim(t.key), ' ') AND (starts_with(trim(t.key), '$') OR lower(substr(trim(t.key), 1, 1)) = substr(trim(t.key), 1, 1))""",
    "listed_text": """SELECT *, lower(array_to_string(list_transform(cats, lambda c: trim((c->>'category_level_0') || ' ' || (c->>'category_level_1'))), ' | ')) AS words,
        array_to_string(list_filter(list_transform(cats, lambda c: trim(regexp_replace(trim(c->>'category_level_0') || ' / ' || trim(c->>'category_level_1'), '^[ /]+|[ /]+$', '', 'g'))), lambda x: x <> ''), ' | ') AS category,
        trim(coalesce(payload->'target_details'->>'notes', '')) AS notes, coalesce(CAST(payload->>'ignore' AS BOOLEAN), false) AS ignored FROM listed""",
    "supplemental_rows": """SELECT CASE WHEN source_group = 'command' THEN 'command' WHEN source_group = 'aggregation_stage' THEN 'stage' ELSE 'operator' END AS feature_type, feature_name, source_group, category AS source_category,
        '' AS source_short_description, '' AS source_doc_url, '' AS source_manual_version, 'supplemental_json' AS baseline_source_kind, source_ref AS baseline_source_ref, ignored AS admin_operational_flag, ignored AS ignore_candidate_from_source, false AS deprecated_flag,
        array_to_string(list_filter([CASE WHEN notes <> '' AND lower(notes) <> 'none' THEN notes END, CASE WHEN category <> '' THEN 'Supplemental categories: ' || category END], lambda x: x IS NOT NULL), ' | ') AS availability_notes, '' AS aliases_json
      FROM (SELECT *, CASE WHEN NOT starts_with(feature_name, '$') THEN 'command' WHEN contains(words, 'aggregation stages') OR contains(words, 'aggregate() stages') THEN 'aggregation_stage' WHEN contains(words, 'update operators') THEN 'update_operator'
          WHEN contains(words, 'projection operators') THEN 'projection_operator' WHEN contains(words, 'query and projection operators') OR contains(words, 'query predicates') THEN 'query_operator' ELSE 'expression_operator' END AS source_group FROM listed_text)""",
    "merged": """SELECT coalesce(l.feature_type, r.feature_type) AS feature_type, coalesce(l.feature_name, r.feature_name) AS feature_name, concat_ws(' | ', nullif(l.source_group, ''), nullif(CASE WHEN l.source_group IS DISTINCT FROM r.source_group THEN r.source_group END, '')) AS source_group,
        concat_ws(' | ', nullif(l.source_category, ''), nullif(CASE WHEN l.source_category IS DISTINCT FROM r.source_category THEN r.source_category END, '')) AS source_category, coalesce(nullif(l.source_short_description, ''), r.source_short_description, '') AS source_short_description,
        coalesce(nullif(l.source_doc_url, ''), r.source_doc_url, '') AS source_doc_url, '8.0' AS source_manual_version, concat_ws(' | ', l.baseline_source_kind, r.baseline_source_kind) AS baseline_source_kind, concat_ws(' | ', nullif(l.baseline_source_ref, ''), r.baseline_source_ref) AS baseline_source_ref,
        coalesce(l.admin_operational_flag, false) OR coalesce(r.admin_operational_flag, false) AS admin_operational_flag, coalesce(l.ignore_candidate_from_source, false) OR coalesce(r.ignore_candidate_from_source, false) AS ignore_candidate_from_source, false AS deprecated_flag,
        concat_ws(' | ', nullif(l.availability_notes, ''), nullif(r.availability_notes, '')) AS availability_notes, '' AS aliases_json FROM documented l FULL JOIN supplemental_rows r ON l.feature_type = r.feature_type AND l.feature_name = r.feature_name""",
    "mapping": """SELECT b.feature_type, b.feature_name, s.key_name IS NOT NULL AS target_matched, CASE WHEN s.key_name IS NOT NULL THEN 'exact' ELSE 'unmatched' END AS target_match_type, CASE WHEN s.key_name IS NOT NULL THEN '1.00' ELSE '0.00' END AS target_match_confidence,
        coalesce(s.section, '') AS target_section, coalesce(s.since, '') AS target_support_since, coalesce(s.since, '') AS target_support_raw, CASE WHEN s.key_name IS NOT NULL THEN '' ELSE 'not_in_target_main_table' END AS target_uncovered_reason
      FROM merged b LEFT JOIN (SELECT DISTINCT key_type, key_name, """
    + squash("section")
    + " AS section, "
    + squash("support_since")
    + """ AS since FROM support_key WHERE key_name <> '') s ON s.key_type = b.feature_type AND s.key_name = b.feature_name""",
    "mapping_usage": f"""SELECT m.feature_type, m.feature_name, CASE m.feature_type WHEN 'command' THEN m.feature_name WHEN 'stage' THEN 'aggregate' ELSE '' END AS command_name, {PSEUDO}, {effective('m.target_support_since', "'26ai'", "'op'")} AS target_support_status,
        m.target_support_since, m.target_section AS target_category, coalesce({squash('b.source_short_description')}, '') AS source_short_description FROM mapping m LEFT JOIN merged b ON m.feature_type = b.feature_type AND m.feature_name = b.feature_name""",
    "mapping_ruled": ruled("mapping_usage"),
    "mapping_adjusted": adjusted("mapping_ruled"),
    "mapping_assessed": judged("mapping_adjusted"),
    "mapping_baseline": rolled("mapping_assessed"),
    "support_usage": support_usage("coalesce(nullif(normalized_status, ''), 'Unknown')"),
    "scenario_usage": support_usage(effective("support_since", "'19c'", "'no-op'")),
    "scenario_ruled": ruled("scenario_usage"),
    "scenario_adjusted": adjusted("scenario_ruled"),
    "scenario_assessed": judged("scenario_adjusted"),
    "scenario_baseline": rolled("scenario_assessed"),
    "scenario_described": """SELECT b.*, d.source_short_description FROM scenario_baseline b LEFT JOIN (SELECT * FROM (SELECT source_entity_type, source_name, section, support_since, source_short_description,
        row_number() OVER (PARTITION BY source_entity_type, source_name, section, support_since ORDER BY row_id) AS rn FROM described_support WHERE source_name <> '') WHERE rn = 1) d
        ON d.source_entity_type = b.feature_type AND d.source_name = b.feature_name AND d.section = b.target_section AND d.support_since = b.target_support_since""",
    "observed": f"SELECT feature_type, feature_name, CAST(sum(usage_count) AS BIGINT) AS observed_usage_count, {sorted_list('command_name')} AS observed_command_contexts FROM counts GROUP BY ALL",
    "scenario_observed": """SELECT b.*, coalesce(o.observed_usage_count, 0) AS observed_usage_count, coalesce(o.observed_command_contexts, '') AS observed_command_contexts, coalesce(o.observed_usage_count, 0) > 0 AS observed_in_profile
        FROM scenario_described b LEFT JOIN observed o ON o.feature_type = b.feature_type AND o.feature_name = b.feature_name""",
}


def check(query: str) -> str:
    """`query` with the steps it mentions put in front of it."""
    needed: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in STEPS:
            if name not in trail and name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text):
                visit(STEPS[name], (*trail, name))
                needed.append(name)

    visit(query, ())
    if not needed:
        return query
    return "WITH " + ",\n".join(f"{name} AS ({STEPS[name].strip()})" for name in needed) + "\n" + query
