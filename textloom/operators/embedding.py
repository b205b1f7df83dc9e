"""Encoding texts through a content-addressed cache.

The encoder is a callable from a list of texts to a matrix; the default needs no model: hashed
words, weighted and normalised."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textloom.functions.text import content_key, ratio
from textloom.session import ship_package, stored
from textloom.sources.versions import Versions

# What is put before queries, batch sizes.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
BATCH = 32

Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a neural encoder: signed word hashes summed per text."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall("[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[row, h % dim] += 1 if h >> 63 else -1
    return out


def normalised(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float32)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norms == 0, 1, norms)).astype(np.float32)


def encode(df: DataFrame, text_col: str, encoder: Encoder = hashed_encoder, is_query: bool = False, out_col: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Adds unit float vectors; queries get the instruction in front. Texts go to the encoder in batches."""

    ship_package(df.sparkSession)

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            items = [(QUERY_PREFIX if is_query else "") + (t or "") for t in series]
            rows = [r for s in range(0, len(items), batch) for r in normalised(encoder(items[s : s + batch]))]
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out_col, run(F.col(text_col)))


def slug(model: str) -> str:
    """A model's name as a folder name."""
    return model.replace("/", "__")


VECTORS = "key string, embedding array<float>"


def cache_of(spark: SparkSession, path: str, model: str) -> Versions:
    """A model's cache: the versioned table `vectors`. append, replace and compact are one step each for its readers."""
    return Versions(spark, f"{path}/{slug(model)}")


def load_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The cached vectors of a model; empty if nothing has been cached."""
    return cache_of(spark, path, model).read("vectors", VECTORS).select(F.lit(model).alias("model"), "key", "embedding")


def replace_cache(vectors: DataFrame, path: str, model: str) -> None:
    """Makes (key, embedding) the model's whole cache; readers see the old one until the new one is complete."""
    cache = cache_of(vectors.sparkSession, path, model)
    cache.replace("vectors", vectors.select("key", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["key"]))


def misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(key, text) of the distinct texts that the model has no vector for."""
    wanted = texts.select(content_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("key IS NOT NULL").groupBy("key").agg(F.min("text").alias("text"))
    return wanted.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def cache_stats(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """One row: total, unique_texts, cached, to_embed, hit_rate."""
    keys = texts.select(content_key(F.col(text_col)).alias("key"))
    known = cache.where(F.col("model") == model).select("key").distinct().withColumn("known", F.lit(1))
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).join(known, "key", "left")
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        F.count("*").alias("unique_texts"),
        F.count("known").alias("cached"),
        (F.count("*") - F.count("known")).alias("to_embed"),
        ratio(F.count("known"), F.count("*")).alias("hit_rate"),
    )


def encode_cached(texts: DataFrame, path: str, model: str, encoder: Encoder = hashed_encoder, text_col: str = "text", on_progress: Callable[[int], None] | None = None, slices: int = 16) -> DataFrame:
    """The rows of texts with their embeddings; only texts not yet cached are encoded.

    What is missing is written once and then encoded in slices by hash of the key, each committed by
    itself: when one fails, those before it are kept and a second call takes up from there.
    Afterwards the slices are made one segment, and what it replaces is deleted with the next call.
    on_progress hears after each slice how many vectors the cache holds."""
    spark, cache = texts.sparkSession, cache_of(texts.sparkSession, path, model)
    if cache.numbers():
        cache.forget()
    wanted = stored(misses(texts, load_cache(spark, path, model), model, text_col), "misses")
    for k in range(slices):
        own = wanted.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k)
        cache.append("vectors", encode(own, "text", encoder).select("key", "embedding"))
        if on_progress:
            on_progress(load_cache(spark, path, model).count())
    cache.compact("vectors", VECTORS, "key", int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = cache.read("vectors", VECTORS).dropDuplicates(["key"])
    return texts.withColumn("_key", content_key(F.col(text_col))).join(vectors.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
