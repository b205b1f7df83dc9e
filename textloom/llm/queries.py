"""The operator queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, embedding_dedup, exact_topk, fill_middle, language_id, license_scan, line_dedup, near_dedup, quote_links, secret_scan, sentencepiece_lattice, source_divergence, sql, token_count
from textloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encoding_summary(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.chat_digest(table(spark, sf_dir, "conversations"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_digest(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_five(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_decontaminate, op4_language_id, op5_sentencepiece, op6_line_dedup, op7_near_dedup, op8_token_counts, op9_quote_links, op10_embedding_dedup, op11_fill_in_middle, op12_exact_topk, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": sql.license_scan_sql(license_scan.TEMPLATES, license_scan.PHRASES), "op2_secret_scan": sql.secret_scan_sql(), "op3_decontaminate": sql.DECONTAMINATE, "op6_line_dedup": sql.line_dedup_sql(), "op9_quote_links": sql.CHAT_QUOTES, "op10_embedding_dedup": sql.EMBEDDING_DEDUP, "op11_fill_in_middle": sql.FILL_IN_MIDDLE, "op12_exact_topk": sql.EXACT_TOPK, "op13_source_divergence": sql.SOURCE_DIVERGENCE}
