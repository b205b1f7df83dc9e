"""Continuous ingestion: new documents as they land, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.functions.text import content_key, normalise_documents


def new_documents(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet rows that land under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_documents(stream: DataFrame, text_col: str = "text", time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Adds key and drops content seen before; with a time column the state is bounded by its watermark."""
    keyed = stream.withColumn("key", content_key(F.col(text_col)))
    if time_col is None:
        return keyed.dropDuplicates(["key"])
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["key"])


def ingest(stream: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Cleans what arrives and appends it to a table; stops when the input is used up."""
    cleaned = normalise_documents(stream, text_col)
    return cleaned.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
