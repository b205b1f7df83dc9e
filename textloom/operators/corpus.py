"""Corpus management: manifests, caps, latest entries, seeded samples, gold-preserving subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def latest_filings(submissions: DataFrame, form: str, limit: int = 1) -> DataFrame:
    """The first `limit` filings of a form per company out of parallel arrays, which stand newest first.

    submissions: (cik, form, filingDate, accessionNumber, primaryDocument), all but cik arrays."""
    zipped = F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument")
    wanted = F.slice(F.filter(zipped, lambda x: x["form"] == form), 1, limit)
    return submissions.select("cik", F.posexplode(wanted).alias("pos", "x")).select("cik", "pos", "x.filingDate", "x.accessionNumber", "x.primaryDocument")


def seeded_order(seed: int, *cols: str) -> Column:
    """A key that orders rows pseudo-randomly and alike on every run."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)), 256)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows by seeded order: a sample that does not depend on partitioning."""
    return df.orderBy(seeded_order(seed, key), key).limit(n)


def gold_subset(chunks: DataFrame, gold: DataFrame, keys: list[str], limit: int, seed: int, id_col: str) -> DataFrame:
    """All gold chunks and seeded distractors up to `limit` rows in all."""
    kept = chunks.join(gold.select(*keys).distinct(), keys, "left_semi")
    room = max(0, limit - kept.count())
    others = chunks.join(gold.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(seeded_sample(others, room, seed, id_col))


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("x"))
    return first.select("x.*")


def with_fetch_metadata(df: DataFrame, content_col: str = "content", path_col: str = "local_path") -> DataFrame:
    """Adds what a manifest records of saved content: format, sha256, retrieved_at."""
    suffix = F.lower(F.regexp_extract(path_col, "\\.([^./\\\\]+)$", 1))
    return df.withColumns({"format": suffix, "sha256": F.sha2(F.col(content_col).cast("binary"), 256), "retrieved_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})


def manifest_counts(manifest: DataFrame, by: str) -> DataFrame:
    return manifest.groupBy(by).agg(F.count("*").alias("n"))
