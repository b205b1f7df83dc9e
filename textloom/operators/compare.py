"""Several encoders on one set of chunks and questions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.embedding import Encoder, cache_stats, encode, encode_cached, load_cache
from textloom.operators.evaluate import MRR_DEPTH, mode_summary, per_query_metrics
from textloom.operators.search import dense_topk


def compare_models(encoders: dict[str, Encoder], chunks: DataFrame, questions: DataFrame, gold: DataFrame, cache: str, k: int = 5) -> DataFrame:
    """One row per model: quality of dense retrieval, vectors newly encoded, minutes of encoding, milliseconds a question.

    chunks: (doc_id, text); questions: (query_id, query, further eval_k); gold: (query_id, doc_id).
    Vectors come from the cache, so a model is encoded once however often it is compared."""
    spark = chunks.sparkSession
    out: DataFrame | None = None
    asked = questions.count()
    for label, encoder in encoders.items():
        new = cache_stats(chunks, load_cache(spark, cache, label), label).first()["to_embed"]
        began = time.perf_counter()
        vectors = encode_cached(chunks, cache, label, encoder).select("doc_id", "embedding")
        minutes = (time.perf_counter() - began) / 60
        began = time.perf_counter()
        queries = encode(questions, "query", encoder, is_query=True, out_col="vector")
        hits = dense_topk(vectors, queries, max(k, MRR_DEPTH), "doc_id", "embedding").persist()
        hits.count()
        each = (time.perf_counter() - began) * 1000 / max(1, asked)
        row = mode_summary(per_query_metrics(questions, hits, gold, k).withColumn("label", F.lit(label)), ["label"])
        dim = vectors.select(F.max(F.size("embedding")).alias("dim")).scalar()
        part = row.select("*", dim.alias("dim"), F.lit(new).alias("chunks_newly_embedded"), F.lit(minutes).alias("embed_minutes"), F.lit(each).alias("query_ms_per_question"))
        out = part if out is None else out.unionByName(part)
    return out
