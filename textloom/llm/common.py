"""Pieces shared by the training-data operators: words, Arrow batches, shared tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ship_package

#: Words are maximal runs of digits, ASCII letters and non-ASCII characters; on the
#: UTF-8 bytes of an ASCII-lower-cased text that is the same as this byte pattern.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Removes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text in order, as UTF-8 bytes; none for null."""
    if text is None:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return WORD_BYTES.findall(raw.lower())


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. The slow translate() runs just where other letters occur."""
    return F.when(col.rlike("[^\\x00-\\x7F]"), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


def words_column(col: Column) -> Column:
    """The same words as words_of(), as an array expression that stays in the JVM."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), SEPARATORS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package and bounds Arrow batches."""
    ship_package(spark)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to each bounded Arrow batch; no shuffle, any partition can be recomputed."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="textloom-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold for a while; dots in their names are written as double underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, **held: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives executors.

    The shuffle files behind it are of no more use, so Spark is told to remove them at once.
    held: further settings while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    with settings(spark, **{CLEANUP.replace(".", "__"): "true"}, **held):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear
        pass


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)
