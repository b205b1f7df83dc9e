"""Reports over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textloom.functions.text import ratio, snippet
from textloom.operators.answers import VERDICTS, answer_summary, summary_columns, verdict_columns, verdict_report
from textloom.operators.evaluate import mode_summary


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored JSON results, or None where there are none."""
    try:
        return spark.read.json(path, multiLine=True)
    except AnalysisException:
        return None


def retrieval_report(per_query: DataFrame) -> DataFrame:
    """One row per mode."""
    return mode_summary(per_query, ["mode"])


def tier_report(per_query: DataFrame, mode: str = "dense") -> DataFrame:
    """One row per k of one mode."""
    return mode_summary(per_query.where(F.col("mode") == mode), ["k"])


def generation_report(trace: DataFrame) -> DataFrame:
    """(faithfulness_flag, n, hit_at_k)."""
    return trace.groupBy("faithfulness_flag").agg(F.count("*").alias("n"), ratio(F.count_if("retrieval_hit_at_k"), F.count("*")).alias("hit_at_k"))


def accuracy_report(scored: DataFrame) -> DataFrame | str:
    """Verdict shares, or a sentence where nothing has been judged."""
    if "judge" not in scored.columns:
        return "answers have not been judged"
    return verdict_report(scored)


def answer_report(scored: DataFrame, verdict_col: str = "judge") -> DataFrame:
    """One row: the summary of scored answers beside their verdicts, each counted, and the shares of the good ones."""
    if verdict_col not in scored.columns:
        return answer_summary(scored)
    counts = [F.count_if(F.col(verdict_col) == v).alias(f"judge_{v.lower()}") for v in (*VERDICTS, "UNPARSED")]
    return scored.agg(*summary_columns(), *counts, *verdict_columns(verdict_col))


def smoke_report(found: DataFrame, label: list[str], text_col: str = "text") -> DataFrame:
    """(query_id, report): what each query found, a line a hit with rank, score, where it is from and how it begins.

    found: hits with their documents' columns, a few for each query; a query without hits has no row."""
    line = F.format_string("%d. [%.3f] %s: %s", "rank", "score", F.concat_ws(" / ", *(F.col(c).cast("string") for c in label)), snippet(F.col(text_col)))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


def latency_report(stages: DataFrame) -> DataFrame:
    """The stages that were timed."""
    return stages.where(F.col("p50_ms").isNotNull())


def embedding_report(models: DataFrame) -> DataFrame:
    """What is compared between models."""
    return models.select("label", "dim", "mrr", "mean_recall_at_k", "mean_precision_at_k", "precision_attainment", "embed_minutes", "query_ms_per_question")
