"""Documents from files, and artifacts kept as tables."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textloom.operators.corpus import with_fetch_metadata
from textloom.operators.extract import no_pdf, text_of
from textloom.session import ship_package
from textloom.sources.versions import Versions


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content, doc_id, format) of every file: doc_id is the file's stem."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select("path", "length", "content", F.regexp_replace(name, "\\.[^.]*$", "").alias("doc_id"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("format"))


def extract_texts(files: DataFrame, pdf: Callable[[bytes], str] = no_pdf) -> DataFrame:
    """Adds text and error: one file that cannot be read leaves its reason, not a failed job."""

    ship_package(files.sparkSession)

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, suffix, path in batches:
            out = []
            for c, s, p in zip(content, suffix, path, strict=True):
                try:
                    out.append((text_of(c, s, p, pdf), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    return files.withColumn("_x", run("content", "format", "path")).select(*files.columns, "_x.text", "_x.error")


RAW = "doc_id string, format string, sha256 string, content binary"


def save_documents(fetched: DataFrame, store: Versions, path_col: str = "local_path") -> DataFrame:
    """Keeps fetched bytes and returns their manifest: the other columns, format, sha256 and retrieved_at.

    fetched: (content, path_col, further metadata). The bytes are rows of the versioned table `raw`, in one step; rows
    without content are left out. A content that is there already under that doc_id is not written again."""
    name = F.element_at(F.split(path_col, "[/\\\\]"), -1)
    described = with_fetch_metadata(fetched.where("content IS NOT NULL"), "content", path_col).withColumn("doc_id", F.regexp_replace(name, "\\.[^.]*$", ""))
    known = store.read("raw", RAW).select("doc_id", "sha256")
    store.append("raw", described.select("doc_id", "format", "sha256", F.col("content").cast("binary").alias("content")).dropDuplicates(["doc_id", "sha256"]).join(known, ["doc_id", "sha256"], "left_anti").select("doc_id", "format", "sha256", "content"))
    return described.drop("content")


def save_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Writes index tables (chunks with their pos, vectors, postings, terms, corpus) under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_artifacts(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Reads index tables; FileNotFoundError with a hint if one is missing."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise FileNotFoundError(f"{path}/{name} is missing: build the index first (save_artifacts)") from e
    return out


def write_result(result: dict | list, path: str) -> None:
    """A small driver-side result as JSON, written beside and then moved into place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(result, f, indent=2)
    os.replace(f"{path}.new", path)


def rewrite_eval_set(remapped: DataFrame, questions: list[dict], path: str, write: bool) -> bool:
    """Applies guarded_remap() to an eval set in place, only if asked and nothing is unresolved."""
    rows = {r["id"]: r for r in remapped.collect()}  # one row per question of a hand-made set
    if not write or any(r["outcome"] == "unresolved" for r in rows.values()):
        return False
    write_result([q | {"gold_chunk_id": rows[q["id"]]["chunk_id"], "gold_section": rows[q["id"]]["section"]} if q["id"] in rows else q for q in questions], path)
    return True
