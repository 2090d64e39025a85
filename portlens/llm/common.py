"""What the operators share: word patterns, stored intermediate tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of anything but ASCII white space, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, as --py-files would."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="portlens-")) / "portlens.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="portlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs the reading of a file and not
    the work before it. The files go by `release`, or when the application ends.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    schema = frame.schema
    frame.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    written = spark.read.schema(schema).parquet(folder)
    written.stored_at = folder
    return written


def release(*frames: DataFrame) -> None:
    """Delete the files of stored tables, once all that is made of them is stored itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def other_columns(frame: DataFrame, row: str = "row") -> list[Column]:
    """An order of rows that are equal in id and text: by all other columns that have an order."""
    found = [F.col(f"{row}.`{f.name}`") for f in frame.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    return found or [F.lit(0)]


def count_words(text: Column) -> Column:
    """Every word, with the white space before it, becomes one sign; the signs are counted."""
    signs = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.length(F.rtrim(signs, F.lit(SPACES))).cast("long")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a number's decimal text, modulo the divisor; a null number counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def byte_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `size`, so that Python objects of few texts live at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)
