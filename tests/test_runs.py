"""Latency of stages, answers with their retrieval, judged answers, kept bytes, and reports over stored rows."""

import hashlib

import pytest

from textloom.operators import generation, latency, reports
from textloom.sources import files
from textloom.sources.versions import Versions


class Clock:
    def __init__(self):
        self.now, self.pauses, self.calls = 0.0, [], []

    def call(self, q):
        self.calls.append(q)
        self.now += len(q) / 1000

    def pause(self, s):
        self.pauses.append(s)
        self.now += s


def test_stage_latencies(spark):
    c, queries = Clock(), ["a", "bb", "ccc", "dddd"]
    how = {"clock": lambda: c.now, "pause": c.pause}
    out = latency.stage_latencies(spark, {"search": c.call}, queries, 2, **how).first()
    assert c.calls == ["a", "bb", *queries] and not c.pauses
    assert (out.stage, out.n) == ("search", 4) and [out.p50_ms, out.p95_ms, out.min_ms, out.max_ms] == pytest.approx([2.5, 3, 1, 4]) and out.qps == pytest.approx(400)
    c.calls = []
    rows = {r.stage: r for r in latency.generation_latencies(spark, c.call, queries, 2, 2, 7.0, **how).collect()}
    assert c.calls == ["a", "a", "bb", "ccc", "dddd"] and c.pauses == [7.0]
    assert rows["generation, paced"].mean_ms == pytest.approx(1.5) and rows["generation, sustained"].mean_ms == pytest.approx(3.5)
    assert reports.latency_report(latency.stage_latencies(spark, {"none": c.call}, [], **how)).count() == 0


def test_bytes_are_kept_once(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "raw"))
    rows = [("a/x.HTM", bytearray(b"one"), "T"), ("a/y.txt", bytearray(b"two"), "T"), ("a/gone.txt", None, "T")]
    fetched = spark.createDataFrame(rows, "local_path string, content binary, title string")
    manifest = {r.doc_id: r for r in files.save_documents(fetched, store).collect()}
    assert {d: (r.format, r.sha256, r.title) for d, r in manifest.items()} == {"x": ("htm", hashlib.sha256(b"one").hexdigest(), "T"), "y": ("txt", hashlib.sha256(b"two").hexdigest(), "T")}
    files.save_documents(fetched, store)
    kept = store.read("raw", files.RAW)
    assert sorted((r.doc_id, bytes(r.content)) for r in kept.collect()) == [("x", b"one"), ("y", b"two")]
    files.write_manifest(files.save_documents(fetched, store), str(tmp_path / "manifest"))
    assert sorted(r.doc_id for r in spark.read.json(str(tmp_path / "manifest")).collect()) == ["x", "y"]


def test_answers_know_their_retrieval_and_their_verdict(spark):
    answered = spark.createDataFrame([(1, "Yes [1]", "cited"), (2, "No", "UNGROUNDED"), (3, "x [1]", "cited")], "query_id long, generated_answer string, faithfulness_flag string")
    metrics = spark.createDataFrame([(1, 1.0), (2, 0.0)], "query_id long, hit_at_k double")
    run = generation.with_retrieval(answered, metrics)
    assert {r.query_id: r.retrieval_hit_at_k for r in run.collect()} == {1: True, 2: False, 3: False}
    assert {(r.faithfulness_flag, r.n, r.hit_at_k) for r in reports.generation_report(run).collect()} == {("cited", 2, 0.5), ("UNGROUNDED", 1, 0.0)}
    asked = []

    def judge(prompt):
        asked.append(prompt)
        return "correct" if "blue" in prompt.split("CANDIDATE:")[-1] else "WRONG."

    scored = spark.createDataFrame([("q1", "blue", "It is blue."), ("q2", "blue", "It is red."), ("q3", "blue", "I cannot answer this from the provided documents.")], "id string, reference_answer string, generated_answer string")
    verdicts = {r.id: r.judge for r in generation.judge_answers(scored, [("local", judge)]).collect()}
    assert verdicts == {"q1": "CORRECT", "q2": "WRONG", "q3": None}
    assert reports.accuracy_report(scored) == "answers have not been judged"


def test_reports_over_metrics(spark):
    rows = [("dense", k, 0.5, 1.0, 0.5, 1.0) for k in (1, 5, 5)] + [("bm25", 5, 0.25, 0.0, 0.5, 0.5)]
    per_query = spark.createDataFrame(rows, "mode string, k int, precision_at_k double, hit_at_k double, max_precision_at_k double, reciprocal_rank double")
    assert {r.mode: r.questions for r in reports.retrieval_report(per_query).collect()} == {"dense": 3, "bm25": 1}
    assert {r.k: (r.questions, r.precision_attainment) for r in reports.tier_report(per_query).collect()} == {1: (1, 1.0), 5: (2, 1.0)}
    models = spark.createDataFrame([("m", 8, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, "more")], "label string, dim int, mrr double, mean_recall_at_k double, mean_precision_at_k double, precision_attainment double, embed_minutes double, query_ms_per_question double, other string")
    assert reports.embedding_report(models).columns == ["label", "dim", "mrr", "mean_recall_at_k", "mean_precision_at_k", "precision_attainment", "embed_minutes", "query_ms_per_question"]


def test_answer_and_search_reports(spark):
    rows = [("a", False, 1.0, True, "CORRECT"), ("b", False, 0.5, False, "UNPARSED"), ("c", True, 0.0, False, None)]
    scored = spark.createDataFrame(rows, "id string, refused boolean, key_fact_recall double, lexical_correct boolean, judge string")
    out = reports.answer_report(scored).first()
    assert (out.questions, out.answered, out.lexical_accuracy, out.judge_correct, out.judge_unparsed, out.judged, out.correct_share) == (3, 2, 0.5, 1, 1, 2, 0.5)
    assert "judged" not in reports.answer_report(scored.drop("judge")).columns
    found = spark.createDataFrame([(1, 2, 0.5, "x", "s", "second\nline"), (1, 1, 0.75, "y", "t", "first"), (2, 1, 0.0, "x", "s", "z" * 200)], "query_id int, rank int, score double, ticker string, section string, text string")
    lines = {r.query_id: r.report.split("\n") for r in reports.smoke_report(found, ["ticker", "section"]).collect()}
    assert lines[1] == ["1. [0.750] y / t: first", "2. [0.500] x / s: second line"] and lines[2] == ["1. [0.000] x / s: " + "z" * 140]
