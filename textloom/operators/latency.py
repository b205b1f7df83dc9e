"""Latency of the stages of a search: single calls from the driver, one after the other, as a user would make them."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from textloom.operators.evaluate import latency_summary

# Calls before the measured ones, and seconds between calls of a paced run.
WARM_UP = 3
PACE_S = 20.0

Call = Callable[[str], object]


def samples(call: Call, queries: Sequence[str], warm_up: int = WARM_UP, pace: float = 0.0, clock: Callable[[], float] = time.perf_counter, pause: Callable[[float], None] = time.sleep) -> list[float]:
    """Milliseconds of a call for each query, after warm_up calls that do not count; pace: seconds between calls, not counted either."""
    for q in queries[:warm_up]:
        call(q)
    out = []
    for q in queries:
        if out and pace:
            pause(pace)
        began = clock()
        call(q)
        out.append((clock() - began) * 1000)
    return out


def stage_latencies(spark: SparkSession, stages: dict[str, Call], queries: Sequence[str], warm_up: int = WARM_UP, **how) -> DataFrame:
    """latency_summary() of every stage: a bounded set of queries for each."""
    rows = [(stage, ms) for stage, call in stages.items() for ms in samples(call, queries, warm_up, **how)]
    return latency_summary(spark.createDataFrame(rows, "stage string, value double"), "stage")


def generation_latencies(spark: SparkSession, generate: Call, queries: Sequence[str], paced: int = 6, sustained: int = 8, pace: float = PACE_S, **how) -> DataFrame:
    """Two figures that must not be mixed: calls far enough apart to show the model alone, and calls back to back, limits on their rate included."""
    rows = [("generation, paced", ms) for ms in samples(generate, queries[:paced], 1, pace, **how)]
    rows += [("generation, sustained", ms) for ms in samples(generate, queries[paced : paced + sustained], 0, **how)]
    return latency_summary(spark.createDataFrame(rows, "stage string, value double"), "stage")
