"""Instance inventory: one JSON document with the server's own replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from portlens.functions.text import blank
from portlens.sources.profile import is_system_database

_SCHEMA = """
hello STRUCT<msg STRING, setName STRING, isWritablePrimary BOOLEAN, secondary BOOLEAN, maxWireVersion BIGINT, hosts ARRAY<STRING>>,
buildInfo STRUCT<version STRING, gitVersion STRING, allocator STRING, modules ARRAY<STRING>>,
hostInfo STRUCT<system STRUCT<hostname STRING, numCores BIGINT, memSizeMB BIGINT, cpuArch STRING, os STRUCT<name STRING, version STRING>>>,
getDefaultRWConcern STRUCT<defaultReadConcern STRING, defaultWriteConcern STRING>,
serverStatus STRUCT<uptime BIGINT, connections STRUCT<current BIGINT, available BIGINT>, mem STRUCT<resident BIGINT, virtual BIGINT>,
  storageEngine STRUCT<name STRING>, metrics STRUCT<commands MAP<STRING, STRING>, aggStageCounters MAP<STRING, STRING>, operatorCounters MAP<STRING, STRING>>>,
listDatabases STRUCT<databases ARRAY<STRUCT<name STRING, sizeOnDisk BIGINT, empty BOOLEAN>>>,
getShardMap STRUCT<`map` MAP<STRING, STRING>, hosts MAP<STRING, STRING>>,
errors MAP<STRING, STRING>
"""


def _entries(value: Column) -> Column:
    return F.coalesce(F.size(value), F.lit(0)).cast("bigint")


def flatten_inventory(documents: DataFrame) -> DataFrame:
    """One row per instance: topology, build, host, load and sharding."""
    d = documents.select("instance", F.col("document"), F.from_json("document", _SCHEMA).alias("d"))
    hello_given = F.size(F.json_object_keys(F.get_json_object("document", "$.hello"))) > 0
    topology = (
        F.when(~F.coalesce(hello_given, F.lit(False)), "")
        .when(F.col("d.hello.msg") == "isdbgrid", "mongos")
        .when(blank("d.hello.setName") != "", "replicaSet")
        .otherwise("standalone")
    )
    shard_keys = F.coalesce(F.map_keys("d.getShardMap.map"), F.map_keys("d.getShardMap.hosts"), F.array().cast("array<string>"))
    shards = F.array_sort(F.filter(shard_keys, lambda k: F.trim(k) != ""))
    metrics = "d.serverStatus.metrics"
    named = F.filter("d.listDatabases.databases", lambda x: F.trim(blank(x["name"])) != "")
    return d.select(
        "instance",
        topology.alias("topology_type"),
        F.col("d.hello.maxWireVersion").alias("max_wire_version"),
        blank("d.hello.setName").alias("set_name"),
        F.coalesce("d.hello.isWritablePrimary", F.lit(False)).alias("is_writable_primary"),
        F.coalesce("d.hello.secondary", F.lit(False)).alias("is_secondary"),
        blank("d.buildInfo.version").alias("version"),
        blank("d.buildInfo.gitVersion").alias("git_version"),
        blank("d.buildInfo.allocator").alias("allocator"),
        F.coalesce(F.array_join("d.buildInfo.modules", ", "), F.lit("")).alias("modules"),
        blank("d.hostInfo.system.hostname").alias("hostname"),
        F.col("d.hostInfo.system.numCores").alias("cpu_cores"),
        F.col("d.hostInfo.system.memSizeMB").alias("mem_size_mb"),
        blank("d.hostInfo.system.cpuArch").alias("cpu_arch"),
        blank("d.hostInfo.system.os.name").alias("os_name"),
        blank("d.hostInfo.system.os.version").alias("os_version"),
        F.coalesce("d.getDefaultRWConcern.defaultReadConcern", F.lit("{}")).alias("default_read_concern"),
        F.coalesce("d.getDefaultRWConcern.defaultWriteConcern", F.lit("{}")).alias("default_write_concern"),
        F.col("d.serverStatus.uptime").alias("uptime"),
        F.col("d.serverStatus.connections.current").alias("connections_current"),
        F.col("d.serverStatus.connections.available").alias("connections_available"),
        blank("d.serverStatus.storageEngine.name").alias("storage_engine"),
        F.col("d.serverStatus.mem.resident").alias("resident_memory_mb"),
        F.col("d.serverStatus.mem.virtual").alias("virtual_memory_mb"),
        _entries(F.col(f"{metrics}.commands")).alias("command_metric_count"),
        _entries(F.col(f"{metrics}.aggStageCounters")).alias("stage_metric_count"),
        _entries(F.col(f"{metrics}.operatorCounters")).alias("operator_metric_count"),
        _entries(named).alias("database_count"),
        F.size(shards).cast("bigint").alias("shard_count"),
        F.array_join(shards, ", ").alias("shard_names"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys("d.errors")), ", "), F.lit("")).alias("failed_commands"),
    )


def inventory_databases(documents: DataFrame) -> DataFrame:
    """One row per instance and database."""
    listed = documents.select("instance", F.explode(F.from_json("document", _SCHEMA).listDatabases.databases).alias("x"))
    name = F.trim(blank("x.name"))
    return listed.filter(name != "").select(
        "instance",
        name.alias("database"),
        F.col("x.sizeOnDisk").alias("size_on_disk"),
        F.coalesce("x.empty", F.lit(False)).alias("empty"),
        is_system_database(name).alias("is_system"),
    )
