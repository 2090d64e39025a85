"""Profiler records: time window, self-read filter and newest-first cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from portlens import fixed
from portlens.functions.text import blank, col
from portlens.operators.events import namespace_parts
from portlens.session import small_side

# Parts into which the records of one database are dealt before the last ranking.
RANKING_PARTS = 64

PROFILE_COLUMNS = (
    "event_key",
    "ts",
    "ns",
    "db",
    "op",
    "command",
    "query",
    "updateobj",
    "millis",
    "nreturned",
    "docsExamined",
    "keysExamined",
    "errCode",
    "errMsg",
)


_CORRUPT = "_corrupt"


def _keyed(raw: DataFrame) -> DataFrame:
    """Times as timestamps, and a key from the content where records have none."""
    names = {c.lower() for c in raw.columns}
    if dict(raw.dtypes).get("ts") == "string":
        moment = F.coalesce(F.get_json_object("ts", "$['$date']"), F.col("ts"))
        raw = raw.withColumn("ts", F.try_to_timestamp(moment).cast("timestamp_ntz"))
    if "event_key" not in names:
        raw = raw.withColumn("event_key", F.xxhash64(*raw.columns))
    return raw


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines (`line`, and any columns of their own) with the record each holds, or NULL.

    A line that is no whole JSON object holds none. A field declared as text
    receives a nested document as its JSON text.
    """
    wanted = [c for c in PROFILE_COLUMNS if c != "event_key"]
    schema = ", ".join(f"`{c}` STRING" for c in (*wanted, _CORRUPT))
    opened = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    whole = F.col("_r").isNotNull() & F.col(f"_r.{_CORRUPT}").isNull() & F.trim("line").rlike(r"^\{(?s:.*)\}$")
    record = F.when(whole, F.struct(*[F.col(f"_r.`{c}`").alias(c) for c in wanted]))
    return lines.withColumn("_r", opened).withColumn("record", record).drop("_r")


def good_records(lines: DataFrame) -> DataFrame:
    """The profiler records of exported lines."""
    return _keyed(parse_lines(lines).filter(F.col("record").isNotNull()).select("record.*"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold no record, as they are; blank ones are no loss and left out."""
    return parse_lines(lines).filter(F.col("record").isNull() & (F.trim("line") != "")).drop("record")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Exported lines with their file, for `good_records` and `rejected_lines`."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_profile(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Exported profiler records, one JSON object per line, or a Parquet table.

    Nested documents are kept as JSON text in their own key order. Times may
    be ISO text or `{"$date": ...}`. Records without an `event_key` get one
    from their content. Broken lines are no records; `rejected_lines` has them.
    """
    return _keyed(spark.read.parquet(path)) if kind == "parquet" else good_records(read_lines(spark, path))


def land_profile(records: DataFrame, root: str) -> None:
    """Add records to a table in folders by day and database.

    Records are brought together by folder; what is too much for one task of it is
    dealt over several, and small folders share one.
    """
    owned = records.withColumns({"event_date": F.to_date("ts"), "db_name": _owner()})
    owned.hint("rebalance", "event_date", "db_name").write.mode("append").partitionBy("event_date", "db_name").parquet(root)


def read_landed(spark: SparkSession, root: str, databases: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Landed records of a time window; only the folders of its days, and of the databases, are read."""
    kept = spark.read.option("basePath", root).parquet(root)
    if start is not None:
        kept = kept.filter((F.col("event_date") >= F.to_date(start)) & (F.col("ts") >= start))
    if end is not None:
        kept = kept.filter((F.col("event_date") <= F.to_date(end)) & (F.col("ts") <= end))
    if databases:
        kept = kept.filter(F.col("db_name").isin(*databases))
    return kept


def landed_days(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Landed records of the (event_date, db_name) pairs that `keys` has.

    The pairs are few and sent along; where they come from a filter, the scan reads
    their folders only.
    """
    return records.join(F.broadcast(keys.select("event_date", "db_name").distinct()), ["event_date", "db_name"], "left_semi")


def is_system_database(name: Column | str) -> Column:
    return F.lower(F.trim(blank(name))).isin(*fixed.SYSTEM_DATABASES)


def _owner() -> Column:
    return namespace_parts("ns", "db")["db_name"]


def scan_profile(
    profile: DataFrame,
    databases: list[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Records of the wanted databases inside an inclusive time window.

    Without a list, all databases but the system ones are taken. Reads of the
    profiler's own collection are no workload and left out.
    """
    names = {c.lower(): c for c in profile.columns}
    kept = profile.select(*[names[c.lower()] if c.lower() in names else F.lit(None).cast("string").alias(c) for c in PROFILE_COLUMNS])
    if start is not None:
        kept = kept.filter(F.col("ts") >= start)
    if end is not None:
        kept = kept.filter(F.col("ts") <= end)
    kept = kept.filter(namespace_parts("ns")["collection_name"] != "system.profile")
    owner = _owner()
    return kept.filter(owner.isin(*databases) if databases else ~is_system_database(owner))


def _cutoff(counts: DataFrame, limit: int) -> DataFrame:
    """Newest bucket per database at which the running count reaches the limit."""
    newest_first = Window.partitionBy("db_name").orderBy(F.desc_nulls_last("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("reached", F.sum("n").over(newest_first))
        .groupBy("db_name")
        .agg(
            F.max(F.when(F.col("reached") >= limit, F.struct("bucket"))).alias("cut"),
            F.max(F.when(F.col("reached") < limit, F.col("reached"))).alias("before"),
        )
    )


def database_totals(profile: DataFrame, limit: int) -> DataFrame:
    """Records per database and whether the cap leaves some of them out."""
    total = F.count(F.lit(1))
    return profile.groupBy(_owner().alias("db_name")).agg(
        F.least(total, F.lit(limit)).cast("bigint").alias("profile_count"), (total > limit).alias("truncated")
    )


def newest(profile: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` records of each database.

    Counting per hour, then per second inside the hour that matters, finds
    the time from which on records can qualify. Only those are ranked, first
    in parts of a database and then what is left of the parts, so no task ranks
    more than a part, also where records lack a time (they count as oldest).
    """
    owned = profile.withColumn("db_name", _owner())

    def counted(frame: DataFrame, unit: str) -> DataFrame:
        return frame.groupBy("db_name", F.date_trunc(unit, col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    hours = small_side(
        _cutoff(counted(owned, "hour"), limit).select(
            "db_name", F.col("cut.bucket").alias("hour"), F.coalesce("before", F.lit(0)).alias("before")
        )
    )
    in_hour = owned.join(hours, "db_name").filter(F.date_trunc("hour", "ts") == F.col("hour"))
    seconds = (
        in_hour.groupBy("db_name", "before", F.date_trunc("second", "ts").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "reached",
            F.col("before") + F.sum("n").over(Window.partitionBy("db_name").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)),
        )
        .filter(F.col("reached") >= limit)
        .groupBy("db_name")
        .agg(F.max("bucket").alias("since"))
    )
    eligible = owned.join(small_side(seconds), "db_name", "left").filter(F.col("since").isNull() | (F.col("ts") >= F.col("since")))
    order = [F.desc_nulls_last("ts"), F.asc("event_key")]
    part = F.pmod(F.xxhash64("event_key", "ts", "command"), F.lit(RANKING_PARTS))
    for keys in (["db_name", "_part"], ["db_name"]):
        ranked = eligible.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        eligible = ranked.filter(F.col("_rank") <= limit).drop("_rank", "_part")
    return eligible.drop("since", "db_name")
