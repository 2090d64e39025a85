"""Tables that are replaced as a whole: new folders first, then one pointer."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def publish(root: str, tables: dict[str, DataFrame], info: dict[str, object] | None = None) -> str:
    """Write the tables as a new version of `root`, then make it the current one; its name comes back.

    A version is a folder of its own, so what reads the one before goes on undisturbed,
    and a run that fails half-way leaves the pointer alone. The pointer is
    written beside and moved into place. `info`, and the number of rows of each table,
    are kept with the version.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{version}/{name}")
    counts = {name: spark.read.parquet(f"{root}/{version}/{name}").count() for name in tables}
    text = json.dumps({"version": version, "rows": counts, "info": info or {}}, ensure_ascii=False, sort_keys=True, default=str)
    files, beside = _place(spark, f"{root}/{version}/{POINTER}")
    out = files.create(beside, True)
    out.write(text.encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, _place(spark, f"{root}/{POINTER}")[1], over)
    return version


def current(spark: SparkSession, root: str) -> dict[str, object] | None:
    """Version, rows and info of the current version; None before the first."""
    files, pointer = _place(spark, f"{root}/{POINTER}")
    if not files.exists(pointer):
        return None
    # Small by its making: one line.
    return json.loads(spark.read.text(pointer.toString(), wholetext=True).first()[0])


def published(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of a named one."""
    found = version or (current(spark, root) or {}).get("version")
    if found is None:
        raise FileNotFoundError(f"{root} has no version")
    return spark.read.parquet(f"{root}/{found}/{table}")
