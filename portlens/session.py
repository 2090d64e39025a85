"""Session settings the library relies on, and durable intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Profiler documents may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Opening the command documents of so much Parquet keeps a core busy for about a minute.
    "spark.sql.files.maxPartitionBytes": "16m",
    # The JVM never compiles methods of more bytecode than this: such stages run without one method for all.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Per-task pre-ranking also for caps as large as the sampling cap.
    "spark.sql.optimizer.windowGroupLimitThreshold": "200000",
}

# A side with at most this many rows is small enough to send to every executor:
# the widest one sent (usage rows with one event key) stays under 200 MB.
BROADCAST_ROWS = 500_000

# As many bare 64-bit keys stay under about the same size.
BROADCAST_KEYS = 5_000_000

# Rows of costly work (a page to parse, a command document to open) that one task takes, up to MOST_PARTS tasks.
TASK_ROWS = 2_000
# Up to as many parts a shuffle writes rows straight to files and holds none in memory.
MOST_PARTS = 200


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only for a local master that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="portlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, gone when the application ends."""
    folder = f"{_shared_folder(spark)}/portlens-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def durable(frame: DataFrame) -> DataFrame:
    """Write a small intermediate result to the shared folder and read it back.

    The folder is the one the cluster names in `spark.checkpoint.dir`, so the
    result outlives lost executors.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(frame.sparkSession))
    return frame.checkpoint(eager=True)


def small_side(frame: DataFrame) -> DataFrame:
    """Store a join side and send it to every executor if it proves small."""
    stored = durable(frame)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def spread(frame: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deal rows over as many tasks as their number asks for, whatever files and row groups they lie in.

    For costly work on each row: a file of one row group is one task, however many rows it holds.
    Rows go by the hash of all their columns, so only copies of a row stay together.
    """
    return frame.repartition(min(MOST_PARTS, max(1, math.ceil(frame.count() / rows))), *[F.col(f"`{c}`") for c in frame.columns])
