"""The registered queries: one Spark function and one check SQL per name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from portlens import fixed
from portlens.cases import checks, inputs
from portlens.functions import naming, support as support_fn, text as text_fn
from portlens.operators import assess as asm, catalog as cat, events as ev, ranks, reports as rep, slices, support as sup, usage as use, walk
from portlens.plans import catalog_sync, usage_analysis
from portlens.session import configure, durable, scratch_folder, spread
from portlens.sources import counters as cnt, evidence, inventory as inv, logs, pages as pg, profile as prof, rules as rul, snapshots, supplemental, versions

# Events whose documents one task makes and opens, up to the most parts that `spread` deals.
EVENT_ROWS = 10_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Inputs:
    """Input frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, sql: str, dealt: bool = False) -> DataFrame:
        """Rows of an input view; `dealt` over tasks by their number, where what follows is costly for each row."""
        for name in TABLES:
            if f"FROM {name}" in sql:
                table = self.table(name)
                (spread(table, EVENT_ROWS) if dealt else table).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    @cached_property
    def profile(self) -> DataFrame:
        """The records as a stored table, which is how a run finds them."""
        root = scratch_folder(self.spark, "records")
        self.view(inputs.PROFILE, dealt=True).write.parquet(root)
        return self.spark.read.parquet(root)

    @cached_property
    def events(self) -> DataFrame:
        return ev.normalize_events(prof.scan_profile(self.profile))

    @cached_property
    def support(self) -> DataFrame:
        return self.view(inputs.SUPPORT)

    @cached_property
    def catalog(self) -> DataFrame:
        rows = self.view(inputs.CATALOG)
        return cat.catalog_from_rows(rows)

    @cached_property
    def rules(self) -> DataFrame:
        return rul.built_in_rules(self.spark)

    @cached_property
    def overrides(self) -> DataFrame:
        return rul.normalize_overrides(rul.small_table(self.spark, rul.OVERRIDE_COLUMNS, inputs.OVERRIDES))

    @cached_property
    def counts(self) -> DataFrame:
        return use.usage_counts(self.events).drop("sample_event")

    @cached_property
    def mapped(self) -> DataFrame:
        return sup.map_support(self.counts, self.support)

    @cached_property
    def assessed(self) -> DataFrame:
        return asm.assess(self.mapped, self.rules, self.overrides, rul.rules_version())

    @cached_property
    def detail(self) -> DataFrame:
        """The assessed table as a run stores it, for reports that read it more than once."""
        return durable(self.assessed)

    @cached_property
    def baseline(self) -> DataFrame:
        return rep.api_baseline(self.assessed)

    @cached_property
    def supplemental(self) -> DataFrame:
        return supplemental.supplemental_entries(self.view(inputs.SUPPLEMENTAL))

    @cached_property
    def merged(self) -> DataFrame:
        return cat.merge_baseline(cat.documented_baseline(self.catalog, "8.0"), self.supplemental, "8.0")

    @cached_property
    def mapping(self) -> DataFrame:
        return cat.compatibility_mapping(self.merged, self.support)

    @cached_property
    def described_support(self) -> DataFrame:
        return cat.enrich_support(self.support, self.catalog)

    @cached_property
    def mapping_baseline(self) -> DataFrame:
        pseudo = sup.mapping_as_usage(self.mapping, self.merged, "26ai", "op")
        return rep.api_baseline(asm.assess(pseudo, self.rules, self.overrides, rul.rules_version()))

    @cached_property
    def scenario_baseline(self) -> DataFrame:
        return catalog_sync.catalog_baseline(self.described_support, self.counts, self.rules, self.overrides, "19c", "no-op")


Build = Callable[[Inputs], DataFrame]
CASES: dict[str, tuple[Build, str | None]] = {}


def case(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        CASES[name] = (build, None if sql is None else checks.check(sql))
        return build

    return register


# --- scans ----------------------------------------------------------------

_WINDOW = ("2024-01-05T00:00:00", "2024-01-20T12:00:00")


@case(
    "profile_scan",
    f"SELECT event_key, ts, ns, op, command, query, updateobj, millis, nreturned, docsExamined, keysExamined, errCode, errMsg FROM scanned WHERE ts >= TIMESTAMP '{_WINDOW[0]}' AND ts <= TIMESTAMP '{_WINDOW[1]}'",
)
def _(i: Inputs) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp_ntz") for t in _WINDOW)
    return prof.scan_profile(i.profile, start=start, end=end).select(
        "event_key", "ts", "ns", "op", "command", "query", "updateobj", "millis", "nreturned", "docsExamined", "keysExamined", "errCode", "errMsg"
    )


@case(
    "profile_scan_databases",
    "SELECT db_name, count(*) AS n, count(DISTINCT collection_name) AS collections FROM scanned WHERE db_name IN ('app_0', 'app_2') GROUP BY db_name",
)
def _(i: Inputs) -> DataFrame:
    kept = prof.scan_profile(i.profile, databases=["app_0", "app_2"]).withColumn("p", ev.namespace_parts("ns", "db"))
    return kept.groupBy("p.db_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p.collection_name").alias("collections"))


@case(
    "newest_n_cap",
    "SELECT event_key, ns, op FROM (SELECT *, row_number() OVER (PARTITION BY db_name ORDER BY ts DESC, event_key) AS rn FROM scanned) WHERE rn <= 250",
)
def _(i: Inputs) -> DataFrame:
    return prof.newest(prof.scan_profile(i.profile), 250).select("event_key", "ns", "op")


@case(
    "database_totals",
    "SELECT db_name, CAST(least(count(*), 1000) AS BIGINT) AS profile_count, count(*) > 1000 AS truncated FROM scanned GROUP BY db_name",
)
def _(i: Inputs) -> DataFrame:
    return prof.database_totals(prof.scan_profile(i.profile), 1000)


_LOG_CANDIDATE = "(regexp_matches(line, '\"c\"\\s*:\\s*\"COMMAND\"') OR contains(line, 'Slow query'))"
_LOG_NAME = (
    "coalesce(list_filter(json_keys(json_extract(line, '$.attr.command')), lambda k: trim(k) <> '' AND k NOT IN ('$db', 'lsid') AND NOT starts_with(k, '$'))[1], "
    "nullif(regexp_extract(line, '\"([A-Za-z][A-Za-z0-9_]*)\"\\s*:', 1), ''), 'unknown')"
)
_LOG_ROWS = (
    f"SELECT {_LOG_NAME} AS name, split_part(json_extract_string(line, '$.attr.ns'), '.', 1) AS db, line, "
    "substr(json_extract_string(line, '$.attr.ns'), strpos(json_extract_string(line, '$.attr.ns'), '.') + 1) AS coll, coalesce(json_extract_string(line, '$.t.\"$date\"'), '') AS seen "
    f"FROM (SELECT line FROM log_lines WHERE {_LOG_CANDIDATE} AND json_valid(line)) l WHERE json_type(json_extract(line, '$.attr')) = 'OBJECT' AND contains(json_extract_string(line, '$.attr.ns'), '.')"
)


@case(
    "log_scan",
    "SELECT 'command' AS feature_type, name AS feature_name, name AS command_name, 'command' AS op_type, db AS database, coll AS collection, CAST(1 AS BIGINT) AS usage_count, "
    f"seen AS first_seen, seen AS last_seen, CAST(NULL AS BIGINT) AS max_duration_ms, 'log.command' AS sample_path, line AS sample_value FROM ({_LOG_ROWS}) WHERE db NOT IN ('admin', 'config', 'local')",
)
def _(i: Inputs) -> DataFrame:
    return logs.log_usage(i.view(inputs.LOG_LINES))


@case(
    "log_counters",
    "SELECT d AS database, (SELECT count(*) FROM log_lines) AS log_scanned_line_count, "
    f"count(*) FILTER (WHERE contains(line, d) AND {_LOG_CANDIDATE}) AS log_matched_line_count FROM log_lines, (SELECT unnest(['app_0', 'app_1', 'missing']) AS d) x GROUP BY d",
)
def _(i: Inputs) -> DataFrame:
    return logs.log_counters(i.view(inputs.LOG_LINES), ["app_0", "app_1", "missing"])


@case("log_command_name", f"SELECT line_no, {_LOG_NAME} AS command_name FROM log_lines WHERE json_valid(line)")
def _(i: Inputs) -> DataFrame:
    lines = i.view(inputs.LOG_LINES).filter(F.json_object_keys("line").isNotNull())
    return lines.select("line_no", logs.log_command_name("line").alias("command_name"))


_COUNT = (
    "CASE WHEN json_type({v}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST({v} AS DOUBLE)) AS BIGINT) WHEN json_type({v}) = 'OBJECT' THEN "
    "CASE WHEN json_type({v}, '$.total') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST(json_extract({v}, '$.total') AS DOUBLE)) AS BIGINT) "
    "ELSE (SELECT CAST(sum(trunc(CAST(x.value AS DOUBLE))) AS BIGINT) FROM json_each({v}) x WHERE x.type IN ('BIGINT', 'UBIGINT', 'DOUBLE')) END END"
)


def _counter_sql(section: str, kind: str, command: str, name: str, path: str, rows: str) -> str:
    return (
        f"SELECT instance, '{kind}' AS feature_type, {name} AS feature_name, {command} AS command_name, 'command' AS op_type, 'INSTANCE_LEVEL' AS database, '' AS collection, n AS usage_count, "
        f"'' AS first_seen, '' AS last_seen, CAST(NULL AS BIGINT) AS max_duration_ms, {path} AS sample_path FROM "
        f"(SELECT c.instance, t.key, t.fullkey, {_COUNT.format(v='t.value')} AS n FROM counters c, {rows} t WHERE t.key IS NOT NULL) WHERE n > 0"
    )


_NOISE = checks._list(fixed.NOISE_COMMANDS)


@case(
    "command_counters",
    _counter_sql("commands", "command", "key", "key", "'metrics.commands.' || key", "json_each(c.metrics, '$.commands')") + f" AND lower(trim(key)) NOT IN {_NOISE}",
)
def _(i: Inputs) -> DataFrame:
    return cnt.command_counters(i.view(inputs.COUNTERS), filter_noise=True).drop("sample_value")


@case(
    "dropped_commands",
    f"SELECT instance, len(d) AS filtered_row_count, array_to_string(list_sort(d), ', ') AS dropped_command_names FROM (SELECT instance, list_filter(json_keys(metrics, '$.commands'), lambda k: lower(trim(k)) IN {_NOISE}) AS d FROM counters)",
)
def _(i: Inputs) -> DataFrame:
    return cnt.dropped_commands(i.view(inputs.COUNTERS))


for _section, _kind, _command, _build in (
    ("aggStageCounters", "stage", "aggregate", cnt.stage_counters),
    ("operatorCounters", "operator", "unknown", cnt.operator_counters),
):
    case(
        f"{_kind}_counters",
        _counter_sql(_section, _kind, f"'{_command}'", "key", "'metrics' || substr(replace(fullkey, '\"', ''), 2)", f"json_tree(c.metrics, '$.{_section}')")
        + " AND starts_with(key, '$') AND NOT contains(fullkey, '[')",
    )(lambda i, b=_build: b(i.view(inputs.COUNTERS)).drop("sample_value"))


@case("counter_values", f"SELECT instance, key AS name, {_COUNT.format(v='value')} AS counted FROM (SELECT c.instance, t.key, t.value FROM counters c, json_each(c.metrics, '$.commands') t)")
def _(i: Inputs) -> DataFrame:
    entries = cnt._section(i.view(inputs.COUNTERS), "commands").select("instance", F.explode(cnt._object("tree")).alias("name", "value"))
    return entries.select("instance", "name", cnt.counter_value("value").alias("counted"))


_J = "json_extract_string(document, '{}')"


@case(
    "inventory_flatten",
    f"""SELECT instance, CASE WHEN len(json_keys(document, '$.hello')) = 0 THEN '' WHEN {_J.format('$.hello.msg')} = 'isdbgrid' THEN 'mongos' WHEN coalesce({_J.format('$.hello.setName')}, '') <> '' THEN 'replicaSet' ELSE 'standalone' END AS topology_type,
      coalesce({_J.format('$.hello.setName')}, '') AS set_name, {_J.format('$.buildInfo.version')} AS version, {_J.format('$.hostInfo.system.hostname')} AS hostname, CAST({_J.format('$.hostInfo.system.numCores')} AS BIGINT) AS cpu_cores,
      CAST({_J.format('$.serverStatus.uptime')} AS BIGINT) AS uptime, CAST(len(json_keys(document, '$.serverStatus.metrics.commands')) AS BIGINT) AS command_metric_count, CAST(0 AS BIGINT) AS stage_metric_count,
      CAST(3 AS BIGINT) AS database_count, coalesce(array_to_string(list_sort(coalesce(json_keys(document, '$.getShardMap.map'), json_keys(document, '$.getShardMap.hosts'))), ', '), '') AS shard_names,
      CAST(len(coalesce(json_keys(document, '$.getShardMap.map'), json_keys(document, '$.getShardMap.hosts'), [])) AS BIGINT) AS shard_count, coalesce(array_to_string(list_sort(json_keys(document, '$.errors')), ', '), '') AS failed_commands,
      CAST(json_extract(document, '$.getDefaultRWConcern.defaultReadConcern') AS VARCHAR) AS default_read_concern, '{{}}' AS default_write_concern, CAST(64 AS BIGINT) AS resident_memory_mb,
      CAST({_J.format('$.hello.maxWireVersion')} AS BIGINT) AS max_wire_version, coalesce(CAST({_J.format('$.hello.isWritablePrimary')} AS BOOLEAN), false) AS is_writable_primary, coalesce(CAST({_J.format('$.hello.secondary')} AS BOOLEAN), false) AS is_secondary,
      coalesce({_J.format('$.buildInfo.gitVersion')}, '') AS git_version, coalesce({_J.format('$.buildInfo.allocator')}, '') AS allocator, array_to_string(json_extract_string(document, '$.buildInfo.modules[*]'), ', ') AS modules,
      CAST({_J.format('$.hostInfo.system.memSizeMB')} AS BIGINT) AS mem_size_mb, {_J.format('$.hostInfo.system.cpuArch')} AS cpu_arch, {_J.format('$.hostInfo.system.os.name')} AS os_name, {_J.format('$.hostInfo.system.os.version')} AS os_version,
      CAST({_J.format('$.serverStatus.connections.current')} AS BIGINT) AS connections_current, CAST({_J.format('$.serverStatus.connections.available')} AS BIGINT) AS connections_available, {_J.format('$.serverStatus.storageEngine.name')} AS storage_engine,
      CAST({_J.format('$.serverStatus.mem.virtual')} AS BIGINT) AS virtual_memory_mb, CAST(len(json_keys(document, '$.serverStatus.metrics.operatorCounters')) AS BIGINT) AS operator_metric_count FROM inventory""",
)
def _(i: Inputs) -> DataFrame:
    return inv.flatten_inventory(i.view(inputs.INVENTORY))


@case(
    "inventory_databases",
    """SELECT instance, trim(t.value->>'name') AS database, CAST(t.value->>'sizeOnDisk' AS BIGINT) AS size_on_disk, coalesce(CAST(t.value->>'empty' AS BOOLEAN), false) AS empty, lower(trim(t.value->>'name')) IN ('admin', 'config', 'local') AS is_system
      FROM inventory, json_each(document, '$.listDatabases.databases') t WHERE trim(t.value->>'name') <> ''""",
)
def _(i: Inputs) -> DataFrame:
    return inv.inventory_databases(i.view(inputs.INVENTORY))


@case(
    "source_priority",
    f"SELECT 'LOG_ONLY' AS strategy, name AS feature_name, db AS database, count(*) AS n FROM ({_LOG_ROWS}) WHERE db NOT IN ('admin', 'config', 'local') GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    nothing = i.profile.filter(F.col("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))
    name, frame = evidence.choose_evidence(
        {
            "PROFILE_ONLY": lambda: use.as_evidence(use.usage_counts(ev.normalize_events(prof.scan_profile(nothing))), "profile"),
            "LOG_ONLY": lambda: use.as_evidence(logs.log_usage(i.view(inputs.LOG_LINES)), "log"),
            "METRICS_ONLY": lambda: use.as_evidence(cnt.counter_usage(i.view(inputs.COUNTERS)), "counters"),
        }
    )
    return frame.groupBy(F.lit(name).alias("strategy"), "feature_name", "database").agg(F.count(F.lit(1)).alias("n"))


def _sources(i: Inputs, profile_of: list[str] | None, logs_of: list[str] | None) -> DataFrame:
    """Usage of the best source; a source asked for databases that it has not has no uses."""
    events = lambda records: ev.normalize_events(prof.scan_profile(records, profile_of))
    chosen = evidence.choose_in_plan(
        {
            "PROFILE_ONLY": (i.profile, lambda r: use.features(events(r)), lambda r: use.as_evidence(use.usage_counts(events(r)), "profile")),
            "LOG_ONLY": (i.view(inputs.LOG_LINES), lambda r: logs.log_usage(r, logs_of), lambda r: use.as_evidence(logs.log_usage(r, logs_of), "log")),
            "METRICS_ONLY": (i.view(inputs.COUNTERS), lambda r: cnt.counter_usage(r, True), lambda r: use.as_evidence(cnt.counter_usage(r, True), "counters")),
        }
    )
    return chosen.groupBy("strategy", "feature_name", "database").agg(F.count(F.lit(1)).alias("n"))


_ELSEWHERE = ["no such database"]
case("source_priority_profile", "SELECT 'PROFILE_ONLY' AS strategy, feature_name, database, count(*) AS n FROM counts GROUP BY ALL")(lambda i: _sources(i, None, None))
case(
    "source_priority_log",
    f"SELECT 'LOG_ONLY' AS strategy, name AS feature_name, db AS database, count(*) AS n FROM ({_LOG_ROWS}) WHERE db NOT IN ('admin', 'config', 'local') GROUP BY ALL",
)(lambda i: _sources(i, _ELSEWHERE, None))
case(
    "source_priority_counters",
    "SELECT 'METRICS_ONLY' AS strategy, feature_name, 'INSTANCE_LEVEL' AS database, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT feature_name FROM ({CASES[name][1]})" for name in ("command_counters", "stage_counters", "operator_counters"))
    + ") GROUP BY feature_name",
)(lambda i: _sources(i, _ELSEWHERE, _ELSEWHERE))


@case("profile_rejects", f"SELECT line_no, line FROM ({inputs.PROFILE_LINES}) WHERE line_no % 9 IN (5, 6, 8) OR (line_no % 9 = 7 AND line_no % 2 = 1)")
def _(i: Inputs) -> DataFrame:
    return prof.rejected_lines(i.view(inputs.PROFILE_LINES))


@case(
    "profile_lines",
    """SELECT 'app_' || (user_id % 3) || '.' || event_type AS ns, 'query' AS op, '{"find":"c","filter":{"a":{"$gt":' || event_id || '}}}' AS command,
      CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS millis, make_timestamp(2024, 1, 1 + event_id % 9, 5, 6, 7.0) AS ts FROM events WHERE event_id % 9 < 5""",
)
def _(i: Inputs) -> DataFrame:
    return prof.good_records(i.view(inputs.PROFILE_LINES)).select("ns", "op", "command", "millis", "ts")


@case(
    "profile_window_pruned",
    f"SELECT CAST(ts AS DATE) AS event_date, db_name, count(*) AS n, max(event_key) AS last_key FROM scanned WHERE ts >= TIMESTAMP '{_WINDOW[0]}' AND ts <= TIMESTAMP '{_WINDOW[1]}' AND db_name IN ('app_0', 'app_2') GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    root = scratch_folder(i.spark, "profile")
    prof.land_profile(prof.scan_profile(i.profile), root)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in _WINDOW)
    kept = prof.read_landed(i.spark, root, ["app_0", "app_2"], start, end)
    return kept.groupBy("event_date", "db_name").agg(F.count(F.lit(1)).alias("n"), F.max("event_key").alias("last_key"))


@case("supplemental_scan", "SELECT * FROM supplemental_rows")
def _(i: Inputs) -> DataFrame:
    return i.supplemental


_RUNS = "SELECT strftime(o_orderdate, '%Y%m') AS run_id, o_orderkey, o_orderstatus FROM orders"


@case("snapshot_latest", f"SELECT * FROM ({_RUNS}) WHERE run_id = (SELECT max(run_id) FROM ({_RUNS}))")
def _(i: Inputs) -> DataFrame:
    runs = i.table("orders").select(F.date_format("o_orderdate", "yyyyMM").alias("run_id"), "o_orderkey", "o_orderstatus")
    return snapshots.latest(runs)


@case("run_round_trip", "SELECT 'r2' AS run_id, o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS row_count FROM orders WHERE o_orderstatus = 'O'")
def _(i: Inputs) -> DataFrame:
    """Two saved runs; the newest is read back with its metadata."""
    root, orders = scratch_folder(i.spark, "runs"), i.table("orders").select("o_orderkey", "o_orderstatus")
    for run, status in (("r1", "F"), ("r2", "O")):
        detail = orders.filter(F.col("o_orderstatus") == status)
        summary = detail.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
        snapshots.save_run(i.spark, root, run, {"detail": detail, "summary": summary}, {"row_count": detail.count()})
    found = snapshots.load_run(i.spark, root)
    count = found["metadata"].select(F.get_json_object("metadata", "$.row_count").cast("bigint").alias("row_count"))
    return found["detail"].select("run_id", "o_orderkey", "o_orderstatus").join(F.broadcast(count))


# --- documentation pages --------------------------------------------------

_SUPPORT_ROWS = """SELECT page_id, table_index, row_index, section, command, operator, since FROM (
  SELECT c_custkey AS page_id, CASE WHEN c_custkey % 6 = 0 THEN 'Guide & ' || c_name ELSE c_mktsegment END AS h, c_custkey FROM customer) c,
  LATERAL (SELECT 1 AS table_index, 0 AS row_index, h AS section, 'find' AS command, '' AS operator, '19c' AS since
    UNION ALL SELECT 1, 1, h, 'cmd' || (c_custkey % 13), '', CASE WHEN c_custkey % 2 = 0 THEN 'Not supported' ELSE '26ai' END
    UNION ALL SELECT 2, 0, h, '', '', ''
    UNION ALL SELECT 3, 0, 'Deep', '', '$op' || (c_custkey % 7), '') r"""


@case(
    "support_tables",
    "SELECT c_custkey AS page_id, r.table_index, r.section, r.column_name, r.value FROM (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 'Guide & ' || c_name ELSE c_mktsegment END AS h FROM customer) c, LATERAL ("
    "SELECT 1 AS table_index, h AS section, 'Command' AS column_name, 'find' AS value UNION ALL SELECT 1, h, 'Support (Since)', '19c' UNION ALL SELECT 1, h, 'Note', 'n Support level full ' || c_nationkey UNION ALL SELECT 2, h, 'Support level', 'full' UNION ALL SELECT 1, h, 'Note_2', '' UNION ALL SELECT 1, h, 'column_5', '' "
    "UNION ALL SELECT 1, h, 'Command', 'cmd' || (c_custkey % 13) UNION ALL SELECT 1, h, 'Support (Since)', CASE WHEN c_custkey % 2 = 0 THEN 'Not supported' ELSE '26ai' END UNION ALL SELECT 1, h, 'Note', 'a' UNION ALL SELECT 1, h, 'Note_2', 'b' UNION ALL SELECT 1, h, 'column_5', 'extra' "
    "UNION ALL SELECT 3, 'Deep', 'Operator', '$op' || (c_custkey % 7) UNION ALL SELECT 3, 'Deep', 'Support', 'yes') r",
)
def _(i: Inputs) -> DataFrame:
    rows = pg.support_tables(i.view(inputs.SUPPORT_PAGES))
    return rows.select("page_id", "table_index", "section", F.explode("cells").alias("column_name", "value"))


@case("support_rows", f"SELECT CAST(page_id * 1000000000 + table_index * 1000000 + row_index AS BIGINT) AS row_id, page_id, table_index, section, command, operator, '' AS stage, since AS support_since FROM ({_SUPPORT_ROWS})")
def _(i: Inputs) -> DataFrame:
    rows = pg.support_rows(i.view(inputs.SUPPORT_PAGES))
    return rows.withColumn("row_id", _place_number("row_id", "table_index", "row_index"))


def _place_number(place: str, table: str, row: str) -> Column:
    """A place as one number, for tables as small as the check's."""
    return (F.col(f"{place}.page_id") * 1_000_000_000 + F.col(f"{place}.{table}") * 1_000_000 + F.col(f"{place}.{row}")).cast("bigint")


_REFERENCE_ROWS = """SELECT CAST(c_custkey * 1000000000 + r.row_no AS BIGINT) AS ordinal, CASE c_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'stage' ELSE 'operator' END AS entity_type,
  CASE c_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'aggregation_stage' ELSE 'query_operator' END AS source_group, CASE WHEN c_custkey % 4 = 0 THEN 'Label ' || c_mktsegment ELSE 'Group ' || c_nationkey END AS category,
  r.name, r.short_description, r.doc_url, 'http://docs.example.org/ref/' || c_mktsegment || '/page.html' AS source_page_url, 'Label ' || c_mktsegment AS source_label FROM customer, LATERAL (
  SELECT 0 AS row_no, 'n' || (c_custkey % 17) AS name, 'Does ' || c_name || CASE WHEN c_custkey % 5 = 0 THEN ' Name Description inner nested text' ELSE '' END AS short_description, 'http://docs.example.org/ref/' || c_mktsegment || '.html' AS doc_url
  UNION ALL SELECT 1, 'm' || (c_custkey % 5), 'Text', 'http://docs.example.org/ref/' || c_mktsegment || '/page.html#x' UNION ALL SELECT 2, 'plain', 'No link', 'http://docs.example.org/ref/' || c_mktsegment || '/page.html'
  UNION ALL SELECT 1000000, 'inner', 'nested text', 'http://docs.example.org/ref/' || c_mktsegment || '/page.html' WHERE c_custkey % 5 = 0) r"""


@case("reference_rows", _REFERENCE_ROWS)
def _(i: Inputs) -> DataFrame:
    rows = pg.reference_rows(i.view(inputs.REFERENCE_PAGES))
    return rows.withColumn("ordinal", _place_number("ordinal", "table_no", "row_no"))


@case(
    "page_catalog",
    f"SELECT entity_type, source_group, name, category, short_description, doc_url FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, source_group, name ORDER BY ordinal) AS rn FROM ({_REFERENCE_ROWS})) WHERE rn = 1",
)
def _(i: Inputs) -> DataFrame:
    catalog = cat.catalog_from_rows(pg.reference_rows(i.view(inputs.REFERENCE_PAGES)))
    return catalog.select("entity_type", "source_group", "name", "category", "short_description", "doc_url")


@case(
    "page_metadata",
    """SELECT page_id, url AS doc_source_url, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'Release 1.' || (page_id % 10) END AS doc_title, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'F' || (10000 + page_id) || '-0' || (page_id % 3) END AS doc_id,
      CASE WHEN page_id % 4 = 3 THEN '' ELSE 'March ' || (2020 + page_id % 5) END AS doc_version_date, CASE WHEN page_id % 4 = 3 THEN '' ELSE '8.' || (page_id % 3) END AS manual_version FROM pages""",
)
def _(i: Inputs) -> DataFrame:
    return pg.page_metadata(i.view(inputs.VERSIONED_PAGES), "Release 1.")


@case(
    "version_change",
    """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 4 = 3 THEN '' ELSE 'F' || (10000 + page_id) || '-0' || (page_id % 3) END AS previous_doc_id,
      CASE WHEN page_id % 10 = 0 THEN 'first record or no earlier version' WHEN page_id % 4 = 3 THEN 'undecided: no current version found' WHEN page_id % 7 = 0 THEN 'document version changed' ELSE 'document version unchanged' END AS update_status FROM pages""",
)
def _(i: Inputs) -> DataFrame:
    current = pg.page_metadata(i.view(inputs.VERSIONED_PAGES), "Release 1.")
    earlier = current.filter(F.col("page_id") % 10 != 0).withColumn(
        "doc_version_date", F.when(F.col("page_id") % 7 == 0, "March 2001").otherwise(F.col("doc_version_date"))
    )
    return cat.version_change(current, earlier, ["page_id"]).select("page_id", "previous_doc_id", "update_status")


@case(
    "empty_cleanup",
    f"SELECT row_id, {checks.clean('section')} AS section, {checks.clean('command')} AS command, {checks.clean('stage')} AS stage, {checks.clean('operator')} AS operator FROM support WHERE trim(section || command || stage || operator) <> ''",
)
def _(i: Inputs) -> DataFrame:
    return rep.drop_empty_rows(i.support.select("row_id", "section", "command", "stage", "operator"), ["section", "command", "stage", "operator"])


@case("non_empty_columns", "SELECT doc_id, lang, source FROM documents")
def _(i: Inputs) -> DataFrame:
    padded = i.table("documents").select("doc_id", "lang", "source", F.lit(" ").alias("gap"), F.lit(None).cast("string").alias("missing"))
    return rep.drop_empty_columns(padded)


@case("content_hash", "SELECT ordinal, sha256(name || '|' || source_group || '|' || short_description || '|' || doc_url) AS content_hash FROM catalog")
def _(i: Inputs) -> DataFrame:
    return i.view(inputs.CATALOG).select("ordinal", cat.content_hash().alias("content_hash"))


_PREVIOUS = "SELECT entity_type, source_group, name, CASE WHEN ordinal % 3 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM catalog_first WHERE ordinal % 4 <> 0"


def _previous(i: Inputs) -> DataFrame:
    older = F.when(F.col("ordinal") % 3 == 0, "old").otherwise(F.col("content_hash"))
    return i.catalog.filter(F.col("ordinal") % 4 != 0).withColumn("content_hash", older)


@case(
    "catalog_changes",
    f"SELECT c.entity_type, c.source_group, c.name, CASE WHEN p.name IS NULL THEN 'new' ELSE 'updated' END AS change FROM catalog_first c LEFT JOIN ({_PREVIOUS}) p ON p.entity_type = c.entity_type AND p.source_group = c.source_group AND p.name = c.name WHERE p.name IS NULL OR p.content_hash <> c.content_hash",
)
def _(i: Inputs) -> DataFrame:
    return cat.catalog_changes(i.catalog, _previous(i))


@case(
    "catalog_delta",
    f"SELECT count(*) AS entry_count, count(*) FILTER (WHERE p.name IS NULL) AS new_entry_count, count(*) FILTER (WHERE p.content_hash <> c.content_hash) AS updated_entry_count, count(DISTINCT c.source_group) AS source_count FROM catalog_first c LEFT JOIN ({_PREVIOUS}) p ON p.entity_type = c.entity_type AND p.source_group = c.source_group AND p.name = c.name",
)
def _(i: Inputs) -> DataFrame:
    return cat.catalog_delta(i.catalog, _previous(i))


@case("catalog_dedupe", "SELECT * FROM catalog_first")
def _(i: Inputs) -> DataFrame:
    return i.catalog


@case("entries_per_source", "SELECT source_label, source_page_url, source_group, count(*) AS entry_count FROM catalog GROUP BY ALL")
def _(i: Inputs) -> DataFrame:
    return cat.entries_per_source(i.view(inputs.CATALOG))


# --- events and features --------------------------------------------------


@case("namespace_split", "SELECT event_key, db_name, collection_name FROM placed")
def _(i: Inputs) -> DataFrame:
    return i.profile.select("event_key", F.inline(F.array(ev.namespace_parts("ns", "db"))))


@case("command_documents", "SELECT event_key, op, command_doc FROM events_table")
def _(i: Inputs) -> DataFrame:
    return i.events.select("event_key", "op", "command_doc")


@case("command_detect", "SELECT event_key, op, command_name FROM events_table")
def _(i: Inputs) -> DataFrame:
    return i.events.select("event_key", "op", "command_name")


@case("command_detect_legacy", "SELECT event_key, op, command_name FROM legacy_events")
def _(i: Inputs) -> DataFrame:
    return ev.normalize_events(prof.scan_profile(i.profile), legacy_detection=True).select("event_key", "op", "command_name")


@case(
    "event_projection",
    "SELECT regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS ts, db_name, collection_name, op, command_name, duration_ms, docs_examined, keys_examined, nreturned, err_code, coalesce(err_msg, '') AS err_msg FROM events_table",
)
def _(i: Inputs) -> DataFrame:
    return ev.event_table(i.events)


def _found_case(name: str, condition: str) -> None:
    columns = "event_key, feature_type, feature_name, sample_path, sample_value"
    case(name, f"SELECT {columns} FROM feats WHERE {condition}")(
        lambda i: use.feature_details(i.events).filter(condition).select(*columns.split(", "))
    )


_found_case("operator_walk", "feature_type = 'operator' AND command_name = 'find'")
_found_case("expression_walk", "feature_type = 'expression'")
_found_case("aggregation_stages", "feature_type = 'stage'")
_found_case("match_operators", "feature_type = 'operator' AND command_name = 'aggregate'")
_found_case("write_operators", "feature_type = 'operator' AND command_name IN ('update', 'delete', 'findAndModify')")
_found_case("command_features", "feature_type = 'command'")


@case("nested_stages", "SELECT event_key, name, position FROM all_stages")
def _(i: Inputs) -> DataFrame:
    staged = F.expr(walk._stages("from_json(command_doc, 'pipeline array<string>').pipeline", "command_doc"))
    rows = i.events.filter("command_name = 'aggregate'").select("event_key", F.explode_outer(staged).alias("s"))
    return rows.filter(F.col("s").isNotNull()).select("event_key", F.col("s")["name"].alias("name"), F.col("s")["position"].cast("bigint").alias("position"))


@case("feature_totals", "SELECT feature_type, feature_name, count(*) AS uses, count(DISTINCT event_key) AS events FROM feats GROUP BY ALL")
def _(i: Inputs) -> DataFrame:
    return use.feature_totals(i.events)


_SHAPE_FEATURES = ", ".join(
    f"({n}, '{kind}', '{name}')" for n, (command, _, found) in enumerate(inputs.SHAPES) for kind, name in [("command", command), *[f.split() for f in found]]
)


@case(
    "walk_shapes",
    f"SELECT feature_type, feature_name, count(*) AS uses, count(DISTINCT event_id) AS events FROM events, (VALUES {_SHAPE_FEATURES}) s(shape, feature_type, feature_name) WHERE event_id % {len(inputs.SHAPES)} = shape GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    return use.feature_totals(i.view(inputs.SHAPE_EVENTS, dealt=True))


@case("usage_counts", "SELECT * FROM counts")
def _(i: Inputs) -> DataFrame:
    return i.counts


@case("usage_rollup", "SELECT * FROM usage_rows")
def _(i: Inputs) -> DataFrame:
    return use.usage_rollup(i.events)


# --- scalar functions -----------------------------------------------------


@case("clean_text", f"SELECT doc_id, {checks.clean('text')} AS cleaned, lower({checks.squash('source')}) AS source_key FROM documents")
def _(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", text_fn.clean_text("text").alias("cleaned"), text_fn.match_key("source").alias("source_key"))


@case(
    "flags_and_defaults",
    "SELECT c_custkey, lower(trim(f)) IN ('1', 'true', 'yes', 'y') AS flag, CASE WHEN lower(trim(f)) IN ('1', 'true', 'yes', 'y') THEN 'true' ELSE 'false' END AS flag_text, coalesce(nullif(trim(f), ''), 'none') AS named FROM "
    "(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN '' WHEN 4 THEN c_mktsegment ELSE 'y ' END AS f FROM customer)",
)
def _(i: Inputs) -> DataFrame:
    flags = F.expr("CASE c_custkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN '' WHEN 4 THEN c_mktsegment ELSE 'y ' END")
    rows = i.table("customer").select("c_custkey", flags.alias("f"))
    return rows.select("c_custkey", text_fn.is_true("f").alias("flag"), text_fn.true_text(text_fn.is_true("f")).alias("flag_text"), text_fn.or_default("f", "none").alias("named"))


@case("status_normalize", f"SELECT row_id, {checks.raw_status('support_since')} AS normalized_status FROM support")
def _(i: Inputs) -> DataFrame:
    return sup.with_status(i.support).select("row_id", "normalized_status")


@case(
    "version_extract",
    f"SELECT row_id, array_to_string(v, ', ') AS versions, list_max(list_transform(v, lambda x: {checks.rank('x')})) AS top_rank FROM (SELECT row_id, {checks.versions('support_since')} AS v FROM support)",
)
def _(i: Inputs) -> DataFrame:
    found = support_fn.versions_in("support_since")
    return i.support.select("row_id", F.array_join(found, ", ").alias("versions"), F.array_max(F.transform(found, support_fn.version_rank)).alias("top_rank"))


_SCENARIOS = [("19c", "op"), ("19c", "no-op"), ("26ai", "op"), ("26ai", "no-op"), ("any", "any"), ("", "op"), ("23 AI", "noop")]


@case(
    "effective_support",
    "SELECT row_id, " + ", ".join(f"{checks.effective('support_since', repr(v), repr('no-op' if m == 'noop' else m))} AS s{n}" for n, (v, m) in enumerate((v.lower(), m) for v, m in _SCENARIOS)) + " FROM support",
)
def _(i: Inputs) -> DataFrame:
    return i.support.select("row_id", *[support_fn.effective_support("support_since", v, m).alias(f"s{n}") for n, (v, m) in enumerate(_SCENARIOS)])


@case(
    "feature_kind",
    "SELECT ordinal, CASE source_group WHEN 'command' THEN 'command' WHEN 'aggregation_stage' THEN 'stage' ELSE 'operator' END AS by_group, "
    "CASE WHEN NOT starts_with(name, '$') THEN 'command' WHEN contains(c, 'aggregation stage') THEN 'stage' ELSE 'operator' END AS by_category, "
    "CASE WHEN NOT starts_with(name, '$') THEN 'command' WHEN contains(c, 'aggregation stages') THEN 'aggregation_stage' WHEN contains(c, 'update operators') THEN 'update_operator' WHEN contains(c, 'query predicates') THEN 'query_operator' ELSE 'expression_operator' END AS group_of "
    "FROM (SELECT *, CASE ordinal % 4 WHEN 0 THEN 'aggregation stages x' WHEN 1 THEN 'update operators y' WHEN 2 THEN 'query predicates' ELSE 'other' END AS c FROM catalog)",
)
def _(i: Inputs) -> DataFrame:
    words = F.expr("CASE ordinal % 4 WHEN 0 THEN 'Aggregation Stages' WHEN 1 THEN 'Update Operators' WHEN 2 THEN 'Query' ELSE 'Other' END")
    tail = F.expr("CASE ordinal % 4 WHEN 0 THEN ' x' WHEN 1 THEN 'y' WHEN 2 THEN 'Predicates' END")
    rows = i.view(inputs.CATALOG).withColumn("c", F.array(F.struct(words.alias("category_level_0"), tail.alias("category_level_1"))))
    return rows.select(
        "ordinal",
        naming.feature_type_of("name", "source_group").alias("by_group"),
        naming.feature_type_of("name", F.lit(""), F.col("c")).alias("by_category"),
        naming.source_group_of("name", F.col("c")).alias("group_of"),
    )


@case("support_key", "SELECT row_id, key_type AS feature_type, key_group AS source_group, key_name AS feature_name FROM support_key")
def _(i: Inputs) -> DataFrame:
    return i.support.select("row_id", F.inline(F.array(naming.support_key("section", "command", "stage", "operator"))))


@case(
    "time_window",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS start_time, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') END AS end_time FROM orders",
)
def _(i: Inputs) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    end = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), iso))
    rows = i.table("orders").select("o_orderkey", text_fn.checked_window(F.date_format("o_orderdate", iso), end).alias("w"))
    return rows.select("o_orderkey", *[F.date_format(f"w.{c}", "yyyy-MM-dd HH:mm").alias(c) for c in ("start_time", "end_time")])


@case("database_of_uri", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'my db' WHEN 2 THEN '' ELSE lower(c_mktsegment) END AS database FROM customer")
def _(i: Inputs) -> DataFrame:
    uri = F.expr("CASE c_custkey % 4 WHEN 1 THEN 'db://u:p@h:1,h2:2/my%20db?x=1' WHEN 2 THEN 'db://h/' ELSE concat('db+srv://h/', lower(c_mktsegment)) END")
    rows = i.table("customer").select("c_custkey", uri.alias("uri"), F.when(F.col("c_custkey") % 4 == 0, " given ").otherwise("").alias("explicit"))
    return rows.select("c_custkey", text_fn.database_of_uri("uri", "explicit").alias("database"))


@case(
    "list_preview",
    "SELECT o_custkey, CASE WHEN len(v) > 5 THEN array_to_string(v[1:5], ', ') || ' ... (total ' || len(v) || ')' ELSE array_to_string(v, ', ') END AS preview FROM (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderdate AS DATE)::VARCHAR)) AS v FROM orders GROUP BY o_custkey)",
)
def _(i: Inputs) -> DataFrame:
    days = i.table("orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("d")).distinct()
    return days.groupBy("o_custkey").agg(F.array_sort(F.collect_list("d")).alias("v")).select("o_custkey", text_fn.preview_list("v").alias("preview"))


@case("json_text", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE '{\"a\":' || event_id || ',\"b\":[1,{\"c\":2}]}' END AS j FROM events")
def _(i: Inputs) -> DataFrame:
    raw = F.expr("CASE WHEN event_id % 5 = 0 THEN '{}' ELSE concat('{\"b\": [1, {\"c\": 2}], \"a\": ', event_id, '}') END")
    return i.table("events").select("event_id", text_fn.json_or_blank(F.parse_json(raw)).alias("j"))


_LEVELS = "CASE {} % 6 WHEN 0 THEN 'Ignore' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Blocker' ELSE 'other' END"


@case(
    "complexity_bounds",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN {checks.complexity_rank('a')} >= {checks.complexity_rank('b')} THEN a ELSE b END AS hi, CASE WHEN {checks.complexity_rank('a')} <= {checks.complexity_rank('b')} THEN a ELSE b END AS lo "
    f"FROM (SELECT l_orderkey, l_linenumber, {_LEVELS.format('l_partkey')} AS a, {_LEVELS.format('l_suppkey')} AS b FROM lineitem)",
)
def _(i: Inputs) -> DataFrame:
    rows = i.table("lineitem").select("l_orderkey", "l_linenumber", F.expr(_LEVELS.format("l_partkey")).alias("a"), F.expr(_LEVELS.format("l_suppkey")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", text_fn.higher(a, b, fixed.COMPLEXITY).alias("hi"), text_fn.lower_of(a, b, fixed.COMPLEXITY).alias("lo")
    )


# --- matching and assessment ----------------------------------------------


@case("support_join", "SELECT * FROM mapped")
def _(i: Inputs) -> DataFrame:
    return i.mapped


_KEYS = "feature_type, feature_name, command_name, op_type, database, collection"


@case("rule_match", f"SELECT {_KEYS}, default_scope, scope_confidence, needs_review, default_complexity, rule_reason AS complexity_reason, rule_action AS recommended_action, review_priority, rule_source FROM ruled")
def _(i: Inputs) -> DataFrame:
    return asm.match_rules(i.mapped, i.rules).select(
        *_KEYS.split(", "), "default_scope", "scope_confidence", "needs_review", "default_complexity", "complexity_reason", "recommended_action", "review_priority", "rule_source"
    )


_ODD = "SELECT DISTINCT 'command' AS kind, w || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS name FROM part, (SELECT unnest([{}]) AS w) x"
_WORDS = ("mapReduce", "fileMD5", "renameCollection", "bulkWrite", "aggregate", "getLog", "moveThing", "listThings", "createThing", "dropThing", "revokeIt", "updateUserX", "shutdown", "fsyncNow", "Find", "somethingElse", "reIndex")
_FALLBACK = checks.fallback("kind", "name")


@case("command_fallback", "SELECT name, " + ", ".join(f"{v} AS {k}" for k, v in _FALLBACK.items()) + " FROM (" + _ODD.format(", ".join(f"'{w}'" for w in _WORDS)) + ")")
def _(i: Inputs) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    names = i.table("part").select(F.explode(F.transform(F.lit(list(_WORDS)), lambda w: F.concat(w, tail))).alias("name")).distinct()
    return names.select("name", F.inline(F.array(asm.fallback(F.lit("command"), text_fn.match_key("name")))))


@case("support_adjust", f"SELECT {_KEYS}, adjusted_complexity, complexity_adjustment_reason FROM adjusted")
def _(i: Inputs) -> DataFrame:
    c = F.col
    ruled = asm.match_rules(i.mapped, i.rules)
    change = asm.adjust_for_support(c("default_scope"), c("default_complexity"), c("_status"), c("_type"), c("_name"))
    return ruled.withColumn("a", change).select(*_KEYS.split(", "), c("a.complexity").alias("adjusted_complexity"), c("a.reason").alias("complexity_adjustment_reason"))


def _assessed_case(name: str, columns: str) -> None:
    case(name, f"SELECT {_KEYS}, {columns} FROM assessed")(lambda i: i.assessed.select(*_KEYS.split(", "), *columns.split(", ")))


_assessed_case("override_apply", "effective_scope, effective_complexity, complexity_reason, recommended_action, override_applied")
_assessed_case("necessity", "default_migration_necessity, effective_migration_necessity, migration_necessity_reason")
_assessed_case("explanation", "complexity_explanation")
_assessed_case("priority", "migration_priority, priority_reason")


@case("assessment", "SELECT * FROM assessed")
def _(i: Inputs) -> DataFrame:
    return i.assessed


@case("assessment_without_overrides", "SELECT * EXCLUDE (x) FROM (SELECT *, 1 AS x FROM (" + checks.judged("(" + checks.adjusted("ruled", overrides=False) + ")") + "))")
def _(i: Inputs) -> DataFrame:
    return asm.assess(i.mapped, i.rules, None, rul.rules_version())


_RETARGETED = f"SELECT {_KEYS}, usage_count, target_support_since, {checks.effective('target_support_since', repr('19c'), repr('no-op'))} AS target_support_status FROM mapped"


@case("retarget", _RETARGETED)
def _(i: Inputs) -> DataFrame:
    return sup.retarget(i.mapped, "19c", "no-op").select(*_KEYS.split(", "), "usage_count", "target_support_since", "target_support_status")


@case("catalog_usage", "SELECT * FROM support_usage")
def _(i: Inputs) -> DataFrame:
    return sup.support_as_usage(i.described_support)


@case(
    "vocabulary_check",
    f"SELECT column_name, value, count(*) AS row_count FROM (SELECT 'default_complexity' AS column_name, CASE row_id % 5 WHEN 0 THEN 'Low' WHEN 1 THEN '' WHEN 2 THEN 'Hard' WHEN 3 THEN 'blocker' ELSE 'Blocker' END AS value FROM support UNION ALL SELECT 'migration_scope', CASE WHEN row_id % 2 = 0 THEN 'ignore' ELSE section END FROM support) "
    f"WHERE value <> '' AND NOT (column_name = 'default_complexity' AND value IN {checks._list(fixed.COMPLEXITY)}) AND NOT (column_name = 'migration_scope' AND value IN {checks._list(fixed.SCOPES)}) GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    frame = i.support.select(
        F.expr("CASE row_id % 5 WHEN 0 THEN 'Low' WHEN 1 THEN '' WHEN 2 THEN 'Hard' WHEN 3 THEN 'blocker' ELSE 'Blocker' END").alias("default_complexity"),
        F.expr("CASE WHEN row_id % 2 = 0 THEN 'ignore' ELSE section END").alias("migration_scope"),
    )
    return rul.invalid_values(frame, {"default_complexity": fixed.COMPLEXITY, "migration_scope": fixed.SCOPES})


@case(
    "override_rows",
    "SELECT feature_type, feature_name, '' AS override_scope, CASE WHEN usage_count > 500 THEN 'High' ELSE '' END AS override_complexity, CASE WHEN starts_with(feature_name, '$m') THEN 'why' ELSE '' END AS override_reason, '' AS override_action, 'true' AS enabled "
    "FROM baseline WHERE feature_type = 'stage' OR usage_count > 500 OR starts_with(feature_name, '$m')",
)
def _(i: Inputs) -> DataFrame:
    edited = i.baseline.withColumns(
        {
            "override_complexity": F.when(F.col("usage_count") > 500, " High ").otherwise(" "),
            "override_reason": F.when(F.col("feature_name").startswith("$m"), "why").otherwise(""),
            "override_enabled": F.col("feature_type") == "stage",
        }
    )
    return rul.overrides_from_baseline(edited)


@case("override_round_trip", f"SELECT * FROM ({CASES['override_rows'][1]})")
def _(i: Inputs) -> DataFrame:
    """Overrides published twice; what is read is the second version, whole."""
    root, rows = scratch_folder(i.spark, "overrides"), durable(CASES["override_rows"][0](i))
    snapshots.publish_overrides(rows.filter("override_complexity = 'High'"), root)
    snapshots.publish_overrides(rows, root)
    return versions.published(i.spark, root, "overrides")


_RULE_FILES = """SELECT p_partkey % 2 AS list, '$' || replace(p_name, ' ', '_') || '_' || p_partkey AS feature_name, CASE p_size % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'High' ELSE '' END AS default_complexity,
  p_partkey % 5 = 0 AS needs_review, 'reason, "' || p_brand || '"' AS complexity_reason FROM part WHERE p_partkey % 7 <> 0"""


@case("rule_files", f"SELECT *, 'v9' AS rules_version FROM ({_RULE_FILES})")
def _(i: Inputs) -> DataFrame:
    """Rules written as two lists with a manifest, and read in their order."""
    root = scratch_folder(i.spark, "rules")
    texts = {
        "feature_name": F.concat(F.lit("$"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string")),
        "feature_type": F.lit("operator"),
        "default_complexity": F.when(F.col("p_size") % 3 == 0, " Low").when(F.col("p_size") % 3 == 1, "High").otherwise(" "),
        "needs_review": F.when(F.col("p_partkey") % 5 == 0, "Yes").otherwise("no"),
        "complexity_reason": F.concat(F.lit('reason, "'), F.col("p_brand"), F.lit('"')),
        "enabled": F.when(F.col("p_partkey") % 7 == 0, "off").otherwise("TRUE"),
    }
    rows = i.table("part").select(F.col("p_partkey"), *[t.alias(n) for n, t in texts.items()])
    for number in (0, 1):
        listed = rows.filter(F.col("p_partkey") % 2 == number).drop("p_partkey")
        listed.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(f"{root}/list_{number}.csv")
    i.spark.range(1).select(F.lit('{"rules_version": "v9", "files": ["list_0.csv", "list_1.csv"]}').alias("value")).write.text(f"{root}/rules_manifest.json")
    found, version = rul.read_rules(i.spark, root)
    return found.select(F.col("ordinal.list").cast("bigint").alias("list"), "feature_name", "default_complexity", "needs_review", "complexity_reason", F.lit(version).alias("rules_version"))


# --- catalogue and baseline -----------------------------------------------


@case("support_enrich", "SELECT * FROM described_support")
def _(i: Inputs) -> DataFrame:
    return i.described_support


@case("baseline_documented", "SELECT * FROM documented")
def _(i: Inputs) -> DataFrame:
    return cat.documented_baseline(i.catalog, "8.0")


@case("baseline_merge", "SELECT * FROM merged")
def _(i: Inputs) -> DataFrame:
    return i.merged


@case("compat_mapping", "SELECT * FROM mapping")
def _(i: Inputs) -> DataFrame:
    return i.mapping


@case("compat_mapping_unloaded", "SELECT feature_type, feature_name, false AS target_matched, 'unmatched' AS target_match_type, '0.00' AS target_match_confidence, '' AS target_section, '' AS target_support_since, '' AS target_support_raw, 'target_feature_support_not_loaded' AS target_uncovered_reason FROM merged")
def _(i: Inputs) -> DataFrame:
    return cat.compatibility_mapping(i.merged, i.support.filter("false"), support_loaded=False)


@case("mapping_usage", "SELECT * FROM mapping_usage")
def _(i: Inputs) -> DataFrame:
    return sup.mapping_as_usage(i.mapping, i.merged, "26ai", "op")


@case(
    "mapping_rollup",
    f"SELECT feature_type, feature_name, bool_or(target_matched) AS target_matched, {checks.sorted_list('target_uncovered_reason')} AS target_uncovered_reason FROM mapping GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    return cat.mapping_rollup(i.mapping)


_JOINED = """SELECT b.feature_type, b.feature_name, b.target_section, b.target_support_since, b.effective_complexity, b.target_support_statuses, d.source_group, d.source_category, coalesce(d.source_short_description, '') AS source_short_description,
  d.baseline_source_kind, d.admin_operational_flag, coalesce(m.matched, false) AS target_matched, coalesce(m.reasons, '') AS target_uncovered_reason FROM mapping_baseline b LEFT JOIN merged d ON d.feature_type = b.feature_type AND d.feature_name = b.feature_name
  LEFT JOIN (SELECT feature_type, feature_name, bool_or(target_matched) AS matched, """ + checks.sorted_list("target_uncovered_reason") + " AS reasons FROM mapping GROUP BY ALL) m ON m.feature_type = b.feature_type AND m.feature_name = b.feature_name"


@case("joined_baseline", _JOINED)
def _(i: Inputs) -> DataFrame:
    return cat.joined_baseline(i.mapping_baseline, i.merged, i.mapping).select(
        *"feature_type feature_name target_section target_support_since effective_complexity target_support_statuses source_group source_category source_short_description baseline_source_kind admin_operational_flag target_matched target_uncovered_reason".split()
    )


_BASE_KEYS = "feature_type, feature_name, target_section, target_support_since"


@case("describe_baseline", f"SELECT {_BASE_KEYS}, usage_count, source_short_description FROM scenario_described")
def _(i: Inputs) -> DataFrame:
    return i.scenario_baseline.select(*_BASE_KEYS.split(", "), "usage_count", "source_short_description")


@case("observed_join", f"SELECT {_BASE_KEYS}, effective_complexity, observed_usage_count, observed_command_contexts, observed_in_profile FROM scenario_observed")
def _(i: Inputs) -> DataFrame:
    return i.scenario_baseline.select(*_BASE_KEYS.split(", "), "effective_complexity", "observed_usage_count", "observed_command_contexts", "observed_in_profile")


@case(
    "observed_rollup",
    f"SELECT CASE WHEN feature_type = 'expression' THEN 'operator' ELSE feature_type END AS feature_type, feature_name, CAST(sum(usage_count) AS BIGINT) AS observed_usage_count, {checks.sorted_list('command_name')} AS observed_command_contexts FROM counts GROUP BY 1, 2",
)
def _(i: Inputs) -> DataFrame:
    return rep.observed_rollup(i.counts, fold_expression=True)


@case(
    "show_overrides",
    f"SELECT {', '.join('b.' + c for c in _BASE_KEYS.split(', '))}, coalesce(trim(o.override_scope), '') AS override_scope, coalesce(trim(o.override_complexity), '') AS override_complexity, coalesce(trim(o.override_action), '') AS override_action, coalesce(trim(o.override_reason), '') AS override_reason, o.ordinal IS NOT NULL AS override_enabled "
    "FROM baseline b LEFT JOIN overrides o ON trim(o.feature_type) = b.feature_type AND trim(o.feature_name) = b.feature_name AND lower(o.enabled) IN ('1', 'true', 'yes', 'y')",
)
def _(i: Inputs) -> DataFrame:
    shown = cat.show_overrides(i.baseline, i.overrides)
    return shown.select(*_BASE_KEYS.split(", "), "override_scope", "override_complexity", "override_action", "override_reason", "override_enabled")


@case(
    "baseline_metadata",
    "SELECT 'entry_count' AS metric, count(*) AS value FROM merged UNION ALL SELECT 'source_count', count(DISTINCT source_group) FROM catalog_first UNION ALL SELECT 'supplemental_entry_count', count(*) FROM supplemental_rows "
    "UNION ALL SELECT 'mapping_entry_count', count(*) FROM mapping UNION ALL SELECT 'matched_count', count(*) FILTER (WHERE target_matched) FROM mapping UNION ALL SELECT 'uncovered_count', count(*) FILTER (WHERE NOT target_matched) FROM mapping",
)
def _(i: Inputs) -> DataFrame:
    return cat.baseline_metadata(i.merged, i.mapping)


# --- reports --------------------------------------------------------------


def _stack(parts: list[tuple[str, str, str, str]], source: str) -> str:
    selects = []
    for metric, column, condition, basis in parts:
        part = "usage_count" if basis == "usage" else "count"
        total = f"(SELECT sum(usage_count) FROM {source} WHERE {condition})" if basis == "usage" else f"(SELECT count(*) FROM {source} WHERE {condition})"
        selects.append(
            f"SELECT '{metric}' AS metric, {column} AS label, count(*) AS count, CAST(sum(usage_count) AS BIGINT) AS usage_count, {checks.pct('count(*)' if part == 'count' else 'sum(usage_count)', total)} AS percentage FROM {source} WHERE {condition} GROUP BY {column}"
        )
    return " UNION ALL ".join(selects)


@case("usage_summary", _stack([("target_support_status", "target_support_status", "true", "rows"), ("feature_type", "feature_type", "true", "usage"), ("command_name", "command_name", "true", "usage")], "mapped"))
def _(i: Inputs) -> DataFrame:
    return rep.usage_summary(i.mapped)


_APP = "effective_scope = 'application_api'"


@case(
    "migration_summary",
    _stack(
        [
            ("effective_complexity", "effective_complexity", "true", "rows"),
            ("effective_scope", "effective_scope", "true", "rows"),
            ("effective_migration_necessity", "effective_migration_necessity", "true", "rows"),
            ("migration_priority", "migration_priority", _APP, "usage"),
            ("target_support_status", "target_support_status", _APP, "rows"),
        ],
        "assessed",
    ),
)
def _(i: Inputs) -> DataFrame:
    return rep.migration_summary(i.assessed)


@case("api_baseline", "SELECT * FROM baseline")
def _(i: Inputs) -> DataFrame:
    return i.baseline


def _top(column: str) -> str:
    return (
        f"(SELECT database, array_to_string(list({column} ORDER BY rn), ', ') AS v FROM (SELECT database, {column}, row_number() OVER (PARTITION BY database ORDER BY count(*) DESC, {column}) AS rn FROM assessed WHERE {column} <> '' GROUP BY database, {column}) WHERE rn <= 3 GROUP BY database)"
    )


_DATABASE_SUMMARY = (
    "SELECT a.*, coalesce(t.v, '') AS top_commands, coalesce(c.v, '') AS top_collections FROM (SELECT database, count(DISTINCT feature_name) AS unique_api_count, CAST(sum(usage_count) AS BIGINT) AS total_usage_count, "
    "count(*) FILTER (WHERE target_support_status = 'Not Supported') AS not_supported_count, count(*) FILTER (WHERE effective_complexity = 'High') AS high_complexity_count FROM assessed GROUP BY database) a "
    f"LEFT JOIN {_top('command_name')} t ON t.database = a.database LEFT JOIN {_top('collection')} c ON c.database = a.database"
)


@case("database_summary", _DATABASE_SUMMARY)
def _(i: Inputs) -> DataFrame:
    return rep.database_summary(i.detail)


@case(
    "database_inventory_join",
    f"SELECT s.*, x.instances, x.size_on_disk FROM ({_DATABASE_SUMMARY}) s LEFT JOIN (SELECT 'app_' || (c_custkey % 3) AS database, count(*) AS instances, CAST(sum(c_custkey * 10) AS BIGINT) AS size_on_disk FROM customer GROUP BY 1) x ON x.database = s.database",
)
def _(i: Inputs) -> DataFrame:
    listed = inv.inventory_databases(i.view(inputs.INVENTORY)).filter("not is_system")
    sizes = listed.groupBy("database").agg(F.count(F.lit(1)).alias("instances"), F.sum("size_on_disk").alias("size_on_disk"))
    return rep.database_summary(i.detail, sizes)


def _value_counts(column: str, source: str = "support", label: str = "label") -> str:
    return f"SELECT {column} AS {label}, count(*) AS count, {checks.pct('count(*)', f'(SELECT count(*) FROM {source})')} AS percentage FROM {source} GROUP BY 1"


@case("status_counts", _value_counts("normalized_status"))
def _(i: Inputs) -> DataFrame:
    return rep.value_counts(i.support, "normalized_status")


_TOP20 = "SELECT label, count, round(CAST(count AS DOUBLE) / sum(count) OVER () * 100, 2) AS percentage FROM (SELECT p_brand AS label, count(*) AS count FROM support GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"


@case("support_top20", _TOP20)
def _(i: Inputs) -> DataFrame:
    return rep.top_values(i.support, "p_brand")


@case(
    "support_summary",
    "SELECT 'normalized_status' AS metric, label AS normalized_status, count, percentage FROM (" + _value_counts("normalized_status") + ") UNION ALL SELECT 'support_value_top20', label, count, percentage FROM ("
    + _TOP20.replace("p_brand", "support_since") + ") UNION ALL SELECT 'section_count', label, count, percentage FROM (" + _value_counts("section") + ")",
)
def _(i: Inputs) -> DataFrame:
    return rep.support_summary(i.support)


@case("labelled_counts", f"SELECT label, count, {checks.pct('count', 'sum(count) OVER ()')} AS percentage FROM (SELECT coalesce(nullif(trim(section), ''), 'Unlabelled') AS label, count(*) AS count FROM support GROUP BY 1)")
def _(i: Inputs) -> DataFrame:
    return rep.labelled_counts(i.support, "section", "Unlabelled")


_MATRIX_ROWS = f"SELECT v AS version, m AS mode, {checks.effective('support_since', 'v', 'm')} AS s FROM support, (SELECT unnest(['19c', '26ai']) AS v) a, (SELECT unnest(['op', 'no-op']) AS m) b"
_MATRIX = f"SELECT mode, version, count(*) AS total_feature_count, count(*) FILTER (WHERE s = 'Supported') AS supported_count, count(*) FILTER (WHERE s = 'Partially Supported') AS partially_supported_count, count(*) FILTER (WHERE s = 'Not Supported') AS not_supported_count, count(*) FILTER (WHERE s = 'Unknown') AS unknown_count FROM ({_MATRIX_ROWS}) GROUP BY ALL"


@case(
    "scenario_matrix",
    f"SELECT *, supported_count || ' / ' || {checks.percent_text('supported_percentage')} || '%' AS point_label, CASE WHEN version = '26ai' THEN CASE WHEN delta_count >= 0 THEN '+' ELSE '' END || delta_count ELSE '' END AS delta_label FROM "
    f"(SELECT *, {checks.pct('supported_count', 'total_feature_count')} AS supported_percentage, max(supported_count) FILTER (WHERE version = '19c') OVER (PARTITION BY mode) AS baseline_supported_count, "
    f"supported_count - max(supported_count) FILTER (WHERE version = '19c') OVER (PARTITION BY mode) AS delta_count FROM ({_MATRIX}))",
)
def _(i: Inputs) -> DataFrame:
    return rep.scenario_matrix(i.support)


_API = "feature_type || '|' || feature_name || '|' || {scope} || '|' || target_support_since"
_HARD = "effective_complexity IN ('High', 'Blocker')"
_HOT = "(effective_complexity IN ('High', 'Blocker') OR (effective_complexity = 'Medium' AND usage_count >= 20))"


def _apis(condition: str = "true", scope: str = "trim(target_category)") -> str:
    return f"count(DISTINCT {_API.format(scope=scope)}) FILTER (WHERE {condition})"


@case(
    "usage_cards",
    f"SELECT {_apis()} AS api_count, {_apis(chr(39).join(['target_support_status = ', 'Supported', '']))} AS supported_count, {_apis(chr(39).join(['target_support_status = ', 'Not Supported', '']))} AS not_supported_count, "
    f"{_apis(_HARD)} AS high_complexity_count, {_apis(_APP + ' AND ' + _HOT)} AS hotspot_count, {_apis(_HOT)} AS report_hotspot_count FROM assessed",
)
def _(i: Inputs) -> DataFrame:
    return rep.usage_cards(i.assessed)


_SECTION = "trim(target_section)"


@case(
    "baseline_cards",
    f"SELECT {_apis(scope=_SECTION)} AS api_count, {_apis('target_matched', _SECTION)} AS matched_count, {_apis('NOT target_matched', _SECTION)} AS uncovered_count, {_apis(_HARD, _SECTION)} AS high_complexity_count, "
    f"CAST(0 AS BIGINT) AS observed_count, {_apis('contains(target_support_statuses, ' + chr(39) + 'Not Supported' + chr(39) + ')', _SECTION)} AS not_supported_count, count(*) FILTER (WHERE source_short_description <> '') AS described_count FROM ({_JOINED})",
)
def _(i: Inputs) -> DataFrame:
    return rep.baseline_cards(cat.joined_baseline(i.mapping_baseline, i.merged, i.mapping))


@case(
    "observed_cards",
    f"SELECT {_apis(scope=_SECTION)} AS api_count, CAST(0 AS BIGINT) AS matched_count, {_apis(scope=_SECTION)} AS uncovered_count, {_apis(_HARD, _SECTION)} AS high_complexity_count, {_apis('observed_in_profile', _SECTION)} AS observed_count, "
    f"{_apis('contains(target_support_statuses, ' + chr(39) + 'Not Supported' + chr(39) + ')', _SECTION)} AS not_supported_count, count(*) FILTER (WHERE source_short_description <> '') AS described_count FROM scenario_observed",
)
def _(i: Inputs) -> DataFrame:
    return rep.baseline_cards(i.scenario_baseline)


@case("support_cards", "SELECT count(*) AS row_count, count(DISTINCT section) AS section_count, count(*) FILTER (WHERE source_short_description <> '') AS described_count FROM described_support")
def _(i: Inputs) -> DataFrame:
    return rep.support_cards(i.described_support)


@case(
    "run_quality",
    "SELECT count(*) AS usage_row_count, round(CAST(count(*) - count(*) FILTER (WHERE rule_source = 'fallback') AS DOUBLE) / count(*), 4) AS rules_coverage_rate, count(*) FILTER (WHERE rule_source = 'fallback') AS unclassified_feature_count, "
    "count(*) FILTER (WHERE override_applied) AS override_count, count(*) FILTER (WHERE target_support_status = 'Unknown') AS unmapped_feature_count, count(*) FILTER (WHERE database = 'INSTANCE_LEVEL') AS instance_level_usage_row_count FROM assessed",
)
def _(i: Inputs) -> DataFrame:
    return asm.run_quality(i.assessed)


@case("unknown_command_events", "SELECT count(*) AS event_count, count(*) FILTER (WHERE command_name = 'unknown') AS unknown_command_event_count FROM events_table")
def _(i: Inputs) -> DataFrame:
    return rep.unknown_command_events(i.events)


@case(
    "run_metadata",
    "SELECT count(*) AS database_count, max(fetched_at) AS fetched_at, CAST(sum(profile_count) AS BIGINT) AS profile_count, bool_or(truncated) AS truncated, CAST(0 AS BIGINT) AS log_scanned_line_count, CAST(0 AS BIGINT) AS log_matched_line_count, CAST(0 AS BIGINT) AS metrics_filtered_row_count, 'system.profile' AS effective_source "
    "FROM (SELECT db_name, least(count(*), 1000) AS profile_count, count(*) > 1000 AS truncated, strftime(max(ts), '%Y-%m-%d') AS fetched_at FROM scanned GROUP BY db_name)",
)
def _(i: Inputs) -> DataFrame:
    scanned = prof.scan_profile(i.profile)
    latest = scanned.groupBy(ev.namespace_parts("ns", "db")["db_name"].alias("db_name")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("fetched_at"))
    per_database = prof.database_totals(scanned, 1000).join(latest, "db_name")
    zeros = {c: F.lit(0) for c in ("log_scanned_line_count", "log_matched_line_count", "metrics_filtered_row_count")}
    return rep.run_metadata(per_database.withColumns(zeros | {"effective_source": F.lit("system.profile")}))


@case(
    "run_metadata_observed",
    f"""SELECT 'PROFILE_ONLY' AS effective_source, CAST(sum(n) AS BIGINT) AS profile_count, bool_or(cut) AS truncated, max(day) AS fetched_on, CAST(0 AS BIGINT) AS log_scanned_line_count, CAST(0 AS BIGINT) AS log_matched_line_count, CAST(0 AS BIGINT) AS metrics_filtered_row_count
      FROM (SELECT least(count(*), 400) AS n, count(*) > 400 AS cut, strftime(max(ts), '%Y-%m-%d') AS day FROM scanned GROUP BY db_name)
      UNION ALL SELECT 'LOG_ONLY', 0, false, '', count(*), count(*) FILTER (WHERE {_LOG_CANDIDATE}), 0 FROM log_lines
      UNION ALL SELECT 'METRICS_ONLY', 0, false, '', 0, 0, sum(len(list_filter(json_keys(metrics, '$.commands'), lambda k: lower(trim(k)) IN {_NOISE}))) FROM counters""",
)
def _(i: Inputs) -> DataFrame:
    """One run from each source: what it read is counted while it is read."""
    runs = [dict(profile=i.profile, limit=400), dict(log_lines=i.view(inputs.LOG_LINES)), dict(counters=i.view(inputs.COUNTERS), filter_noise=True)]
    rows = [usage_analysis.analyze(i.support, i.rules, i.overrides, **run).metadata for run in runs]
    names = ["effective_source", "profile_count", "truncated", F.substring("fetched_at", 1, 10).alias("fetched_on"), "log_scanned_line_count", "log_matched_line_count", "metrics_filtered_row_count"]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(*names)


@case("available_versions", f"SELECT version, {checks.rank('version')} AS version_rank FROM (SELECT DISTINCT unnest({checks.versions('support_since')}) AS version FROM support)")
def _(i: Inputs) -> DataFrame:
    return rep.available_versions(i.support, ["support_since"])


@case(
    "merged_options",
    "SELECT DISTINCT 'target_support_status' AS facet, target_support_status AS value FROM assessed UNION SELECT 'op_type', op_type FROM assessed UNION SELECT 'feature_type', feature_type FROM assessed UNION SELECT 'command_name', command_name FROM assessed "
    "UNION SELECT 'effective_complexity', effective_complexity FROM assessed UNION SELECT 'scope', effective_migration_necessity FROM assessed WHERE effective_migration_necessity <> '' "
    "UNION SELECT 'target_support_status', trim(v) FROM (SELECT unnest(string_split(target_support_statuses, ',')) AS v FROM mapping_baseline) WHERE trim(v) <> '' UNION SELECT 'scope', effective_migration_necessity FROM mapping_baseline WHERE effective_migration_necessity <> ''",
)
def _(i: Inputs) -> DataFrame:
    return rep.merged_options(i.detail, i.mapping_baseline)


@case("available_versions_default", "SELECT * FROM (VALUES ('19c', CAST(38 AS BIGINT)), ('26ai', CAST(53 AS BIGINT))) t(version, version_rank)")
def _(i: Inputs) -> DataFrame:
    return rep.available_versions(i.support, ["section"])


@case(
    "facet_options",
    "SELECT DISTINCT facet, trim(value) AS value FROM (SELECT 'feature_type' AS facet, feature_type AS value FROM baseline UNION ALL SELECT 'effective_complexity', effective_complexity FROM baseline "
    "UNION ALL SELECT 'target_support_statuses', unnest(string_split(target_support_statuses, ',')) FROM baseline UNION ALL SELECT 'command_contexts', unnest(string_split(command_contexts, ',')) FROM baseline) WHERE trim(value) <> ''",
)
def _(i: Inputs) -> DataFrame:
    columns = ["feature_type", "effective_complexity", "target_support_statuses", "command_contexts"]
    return rep.facet_options(i.baseline, columns, split=("target_support_statuses", "command_contexts"))


@case(
    "status_segments",
    "SELECT section, count(*) FILTER (WHERE s = 'Supported') AS supported, count(*) FILTER (WHERE s = 'Not Supported') AS not_supported, count(*) FILTER (WHERE s = 'Partially Supported') AS partially_supported, "
    f"count(*) FILTER (WHERE s NOT IN ('Supported', 'Not Supported', 'Partially Supported')) AS other FROM (SELECT section, {checks.raw_status('support_since')} AS s FROM support) GROUP BY section",
)
def _(i: Inputs) -> DataFrame:
    return rep.status_segments(sup.with_status(i.support))


# --- sinks and orders -----------------------------------------------------


@case("catalog_round_trip", "SELECT feature_type, feature_name, target_matched, target_section, target_support_since, (SELECT count(*) FROM mapping) AS mapping_count, (SELECT count(*) FROM mapping WHERE target_matched) AS matched_count, (SELECT count(*) FROM merged) AS baseline_rows FROM mapping")
def _(i: Inputs) -> DataFrame:
    root = scratch_folder(i.spark, "catalog")
    snapshots.publish_catalog(durable(i.merged), durable(i.mapping), root, "8.0")
    told = versions.current(i.spark, root)
    counts = {"mapping_count": told["info"]["mapping_count"], "matched_count": told["info"]["matched_count"], "baseline_rows": told["rows"]["api_baseline"]}
    rows = versions.published(i.spark, root, "compat_mapping").select("feature_type", "feature_name", "target_matched", "target_section", "target_support_since")
    return rows.withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


@case("support_round_trip", f"SELECT * FROM ({CASES['support_summary'][1]})")
def _(i: Inputs) -> DataFrame:
    root = scratch_folder(i.spark, "support")
    snapshots.publish_support(i.support, root, pg.page_metadata(i.view(inputs.VERSIONED_PAGES), "Release 1."))
    return versions.published(i.spark, root, "summary")


@case(
    "status_columns",
    f"SELECT named, s AS normalized_status, count(*) AS n FROM (SELECT named, CASE WHEN named = 'none' THEN 'Other' ELSE {checks.raw_status('support_since')} END AS s FROM support, (VALUES ('support_since'), ('Target STATUS'), ('none')) v(named)) GROUP BY ALL",
)
def _(i: Inputs) -> DataFrame:
    """Support cells under their usual name, under a hint, and under neither."""
    parts = []
    for name in ("support_since", "Target STATUS", "none"):
        frame = i.support.select("section", F.col("support_since").alias(name))
        parts.append(sup.with_status(frame, sup.status_column(frame.columns)).select(F.lit(name).alias("named"), "normalized_status"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("named", "normalized_status").agg(F.count(F.lit(1)).alias("n"))


_PLACE = "command_name, op_type, database, collection"


@case("usage_order", f"SELECT row_number() OVER (ORDER BY usage_count DESC, feature_type, feature_name, database, collection, op_type, command_name) AS rank, {_KEYS}, usage_count FROM counts")
def _(i: Inputs) -> DataFrame:
    return ranks.ranked(i.counts.select(*_KEYS.split(", "), "usage_count"), [*use.usage_order(), F.asc("command_name")])


@case(
    "assessed_order",
    f"SELECT row_number() OVER (ORDER BY {checks.complexity_rank('effective_complexity')} DESC, {checks.priority_rank('migration_priority')} DESC, usage_count DESC, feature_type, feature_name, {_PLACE}) AS rank, {_KEYS} FROM assessed",
)
def _(i: Inputs) -> DataFrame:
    return ranks.ranked(i.assessed, asm.assessed_order()).select("rank", *_KEYS.split(", "))


@case(
    "hotspot_order",
    f"SELECT row_number() OVER (ORDER BY {checks.priority_rank('migration_priority')} DESC, {checks.complexity_rank('effective_complexity')} DESC, usage_count DESC, max_duration_ms DESC NULLS LAST, feature_type, feature_name, {_PLACE}) AS rank, {_KEYS} FROM assessed WHERE {_APP} AND {_HOT}",
)
def _(i: Inputs) -> DataFrame:
    return ranks.ranked(asm.hotspots(i.assessed), asm.hotspot_order()).select("rank", *_KEYS.split(", "))


@case("baseline_order", f"SELECT row_number() OVER (ORDER BY usage_count DESC, feature_type, feature_name, target_section, target_support_since) AS rank, {_BASE_KEYS} FROM baseline")
def _(i: Inputs) -> DataFrame:
    return ranks.ranked(i.baseline, [*rep.api_baseline_order(), F.asc("target_support_since")]).select("rank", *_BASE_KEYS.split(", "))


# --- slices ---------------------------------------------------------------


@case(
    "filter_support",
    "SELECT row_id, section FROM described_support WHERE section IN ('Administration', 'Update Operators') AND normalized_status IN ('Supported', 'Other') AND (contains(lower(command), 'e') OR contains(lower(operator), 'e') OR contains(lower(stage), 'e') OR contains(lower(source_short_description), 'e') OR contains(lower(source_doc_url), 'e'))",
)
def _(i: Inputs) -> DataFrame:
    return slices.filter_support(i.described_support, " E", ["Administration", "Update Operators"], ["Supported", "Other"]).select("row_id", "section")


@case(
    "report_filter",
    "SELECT row_id FROM described_support WHERE source_short_description <> '' AND contains(lower(command || ' ' || operator || ' ' || stage || ' ' || source_short_description || ' ' || source_doc_url), 'about red')",
)
def _(i: Inputs) -> DataFrame:
    return slices.filter_support(i.described_support, "about RED", report_search=True, described_only=True).select("row_id")


@case(
    "filter_usage",
    f"SELECT {_KEYS}, usage_count FROM assessed WHERE database IN ('app_0', 'app_1') AND target_support_status IN ('Supported', 'Not Supported') AND op_type IN ('command', 'query') AND feature_type IN ('stage', 'operator') AND effective_complexity IN ('Low', 'High') AND effective_migration_necessity = 'Required' "
    "AND contains(lower(concat_ws('\n', database, feature_name, collection, op_type, command_name, target_category, target_support_since, target_support_status, effective_complexity, effective_migration_necessity, recommended_action)), 'c')",
)
def _(i: Inputs) -> DataFrame:
    kept = slices.filter_usage(
        i.assessed,
        databases=["app_0", "app_1"],
        statuses=["Supported", "Not Supported"],
        op_types=["command", "query"],
        feature_types=["stage", "operator"],
        complexities=["Low", "High"],
        necessities=["Required"],
        keyword="C",
    )
    return kept.select(*_KEYS.split(", "), "usage_count")


@case(
    "set_overlap_filter",
    f"SELECT {_BASE_KEYS}, observed_usage_count FROM scenario_observed WHERE observed_in_profile AND list_has_any(list_transform(string_split(target_support_statuses, ','), lambda x: trim(x)), ['Supported', 'Unknown']) AND list_has_any(list_transform(string_split(feature_name || ',' || observed_command_contexts, ','), lambda x: trim(x)), ['aggregate', '$gt'])",
)
def _(i: Inputs) -> DataFrame:
    kept = slices.filter_baseline(i.scenario_baseline, statuses=["Supported", "Unknown"], commands=["aggregate", "$gt"], only_observed=True)
    return kept.select(*_BASE_KEYS.split(", "), "observed_usage_count")


@case("risk_items", f"SELECT {_KEYS}, target_support_status FROM assessed WHERE target_support_status IN ('Partially Supported', 'Not Supported', 'Unknown') AND feature_type IN ('stage', 'expression')")
def _(i: Inputs) -> DataFrame:
    return slices.risks(i.assessed, feature_types=["stage", "expression"]).select(*_KEYS.split(", "), "target_support_status")


@case("hotspots", f"SELECT {_KEYS}, usage_count, effective_complexity, migration_priority FROM assessed WHERE {_APP} AND {_HOT}")
def _(i: Inputs) -> DataFrame:
    return asm.hotspots(i.assessed).select(*_KEYS.split(", "), "usage_count", "effective_complexity", "migration_priority")


@case("excluded", f"SELECT {_KEYS}, effective_scope FROM assessed WHERE effective_scope IN ('ignore', 'likely_admin')")
def _(i: Inputs) -> DataFrame:
    return asm.excluded(i.assessed).select(*_KEYS.split(", "), "effective_scope")


@case("level_split", "SELECT 'database' AS level, count(*) AS row_count, CAST(sum(usage_count) AS BIGINT) AS usage_count FROM counts UNION ALL SELECT 'instance', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT " + _COUNT.format(v="t.value") + " AS n FROM counters c, json_tree(c.metrics, '$.aggStageCounters') t WHERE starts_with(t.key, '$') AND NOT contains(t.fullkey, '[')) WHERE n > 0")
def _(i: Inputs) -> DataFrame:
    both = use.as_evidence(i.counts, "profile").unionByName(
        use.as_evidence(cnt.stage_counters(i.view(inputs.COUNTERS)).drop("instance"), "counters"), allowMissingColumns=True
    )
    sums = lambda level, rows: rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum("usage_count").alias("usage_count")).select(F.lit(level).alias("level"), "*")
    return sums("database", slices.database_level(both)).unionByName(sums("instance", slices.instance_level(both)))


@case("evidence_drilldown", f"SELECT {_KEYS}, usage_count, first_seen, last_seen FROM assessed WHERE feature_type = 'stage' AND feature_name = '$match' AND command_name = 'aggregate' AND op_type = 'command' AND database = 'app_1' AND collection = 'click' AND target_support_status = (SELECT max(target_support_status) FROM assessed WHERE feature_type = 'stage' AND feature_name = '$match')")
def _(i: Inputs) -> DataFrame:
    row = slices.evidence(i.assessed, feature_type="stage", feature_name="$match", command_name="aggregate", op_type="command", database="app_1", collection="click")
    return row.select(*_KEYS.split(", "), "usage_count", "first_seen", "last_seen")


@case(
    "worst_first",
    f"SELECT {_KEYS}, usage_count, max_duration_ms, target_support_status, target_support_since, effective_complexity, migration_priority, recommended_action FROM ({checks.judged('(' + checks.adjusted('ruled', overrides=False) + ')')}) WHERE {_APP} AND {_HOT}",
)
def _(i: Inputs) -> DataFrame:
    return usage_analysis.worst_first(i.profile, i.support, i.rules)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, b=build: b(Inputs(spark, sf_dir))) for name, (build, _) in CASES.items()}


def check_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items() if sql is not None}
