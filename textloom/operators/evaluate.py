"""Retrieval metrics per query and per mode, and the latency summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import ratio
from textloom.session import stored

# Depth of the reciprocal rank, and the default question type.
MRR_DEPTH = 20
KNOWN_ITEM = "known-item"


def section_sizes(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size): chunks per gold unit."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("size"))


def per_query_metrics(questions: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """One row per question from one ranking of depth max(MRR_DEPTH, every k).

    questions: (query_id, further eval_k, question_type if there); hits: (query_id, doc_id,
    rank); gold: (query_id, doc_id). Precision divides by the number retrieved, not by k."""
    asked = questions.select("query_id", *asked_as(questions, k))
    marked = hits.join(gold.select("query_id", "doc_id").distinct().withColumn("match", F.lit(True)), ["query_id", "doc_id"], "left")
    sizes = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("gold_size"))
    return judged(asked.join(marked, "query_id", "left"), sizes)


def section_metrics(questions: DataFrame, hits: DataFrame, sizes: DataFrame, keys: list[str] | None = None, k: int = 5) -> DataFrame:
    """One row per question whose gold is one unit of several chunks, a section of a document.

    questions: (query_id, gold_<key> for every key, further eval_k, question_type if there); hits: chunks
    (query_id, keys, rank) to depth max(MRR_DEPTH, every k); sizes: (keys, size) of section_sizes().
    Any chunk of the unit matches, and each counts; the best precision is min(size, k) / k."""
    keys = keys or ["doc_id", "section"]
    gold = questions.select("query_id", *(F.col(f"gold_{c}") for c in keys))
    is_gold = F.lit(True)
    for c in keys:
        is_gold = is_gold & F.coalesce(F.col(c) == F.col(f"gold_{c}"), F.lit(False))
    marked = hits.join(gold, "query_id").withColumn("match", F.when(is_gold, F.lit(True)))
    of_gold = gold.join(sizes.select(*(F.col(c).alias(f"gold_{c}") for c in keys), F.col("size").alias("gold_size")), [f"gold_{c}" for c in keys]).select("query_id", "gold_size")
    asked = questions.select("query_id", *asked_as(questions, k))
    return judged(asked.join(marked.select("query_id", "rank", "match"), "query_id", "left"), of_gold)


def asked_as(questions: DataFrame, k: int) -> list:
    """The columns k and question_type of questions, with their defaults."""
    own_k = F.coalesce(F.col("eval_k"), F.lit(k)) if "eval_k" in questions.columns else F.lit(k)
    kind = F.coalesce(F.col("question_type"), F.lit(KNOWN_ITEM)) if "question_type" in questions.columns else F.lit(KNOWN_ITEM)
    return [own_k.alias("k"), kind.alias("question_type")]


def judged(ranked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Metrics of (query_id, k, question_type, rank, match) with the sizes (query_id, gold_size) of what is to be found."""
    within = F.col("rank") <= F.col("k")
    out = (
        ranked.groupBy("query_id", "k", "question_type")
        .agg(
            F.count_if(within).alias("retrieved"),
            F.count_if(within & F.col("match").isNotNull()).alias("matched"),
            F.min(F.when(F.col("match").isNotNull() & (F.col("rank") <= MRR_DEPTH), F.col("rank"))).alias("first"),
        )
        .join(sizes, "query_id", "left")
    )
    ceiling = ratio(F.least(F.coalesce("gold_size", F.lit(0)), F.col("k")), F.col("k"))
    precision = ratio(F.col("matched"), F.col("retrieved"))
    return out.select(
        "query_id",
        "k",
        "question_type",
        precision.alias("precision_at_k"),
        F.when(F.col("matched") > 0, 1.0).otherwise(0.0).alias("hit_at_k"),
        ceiling.alias("max_precision_at_k"),
        ratio(precision, ceiling).alias("precision_attainment"),
        ratio(F.lit(1), F.col("first")).alias("reciprocal_rank"),
    )


def mode_summary(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means per group; attainment is a ratio of sums, not a mean of ratios."""
    return per_query.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.avg("precision_at_k").alias("mean_precision_at_k"),
        F.avg("hit_at_k").alias("mean_recall_at_k"),
        F.avg("max_precision_at_k").alias("mean_max_precision_at_k"),
        ratio(F.sum("precision_at_k"), F.sum("max_precision_at_k")).alias("precision_attainment"),
        F.avg("reciprocal_rank").alias("mrr"),
    )


def compare_modes(questions: DataFrame, hits_by_mode: dict[str, DataFrame], gold: DataFrame, k: int = 5) -> DataFrame:
    """Per-query metrics of several modes, one table."""
    out = None
    for mode, hits in hits_by_mode.items():
        part = per_query_metrics(questions, hits, gold, k).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def values_at(samples: DataFrame, places: DataFrame, by: str, value: str) -> DataFrame:
    """(by, place, value): the value at each place, from 1, of the group's values in order.

    places: (by, place). The distinct values with their counts are range-partitioned by (group, value) and stored;
    the counts of a group's ranges tell which range holds a place, and only that range is
    put in order. A task sorts one range, never a group, however large."""
    counted = samples.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counted.repartitionByRange(n, by, value).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "part").agg(F.sum("c").alias("size"))  # one row for each range, at most
    upto = sizes.withColumn("upto", F.sum("size").over(Window.partitionBy(by).orderBy("part"))).withColumn("before", F.col("upto") - F.col("size"))
    wanted = places.join(upto, by).where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("upto"))).select(by, "part", "place", "before")
    inner = ranged.join(wanted.select(by, "part", "before").distinct(), [by, "part"])
    inner = inner.withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy(by, "part").orderBy(value))).withColumn("begin", F.col("end") - F.col("c"))
    held = inner.select(by, "part", value, "begin", "end").join(wanted.select(by, "part", "place"), [by, "part"])
    return held.where((F.col("place") > F.col("begin")) & (F.col("place") <= F.col("end"))).select(by, "place", value)


def latency_summary(samples: DataFrame, by: str, value: str = "value") -> DataFrame:
    """n, p50 (the median), p95, mean, min, max and queries a second per group of milliseconds.

    p95 is the sample at place int(0.95 n) of the sorted ones, the last one for n = 1. Groups without
    a sample have n = 0 and no values."""
    whole = samples.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    last = F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.95)))).cast("bigint")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    spots = whole.where("n > 0").select(by, F.explode(F.array(F.struct(F.lit("low").alias("spot"), low.alias("place")), F.struct(F.lit("high").alias("spot"), high.alias("place")), F.struct(F.lit("p95").alias("spot"), last.alias("place")))).alias("x")).select(by, "x.spot", "x.place")
    found = values_at(samples, spots.select(by, "place").distinct(), by, value)
    at = lambda spot: F.max(F.when(F.col("spot") == spot, F.col(value).cast("double")))
    wide = spots.join(found, [by, "place"]).groupBy(by).agg(((at("low") + at("high")) / 2).alias("p50_ms"), at("p95").alias("p95_ms"))
    out = whole.join(wide, by, "left").withColumn("qps", ratio(F.lit(1000.0), F.col("p50_ms")))
    return out.select(by, "n", "p50_ms", "p95_ms", "mean_ms", "min_ms", "max_ms", "qps")
