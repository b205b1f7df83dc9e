"""Retrieval, metrics, answers, cache, sources and streaming, on literal cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import answers, corpus, embedding, evaluate, generation, reports, search
from textloom.sources import files, http
from textloom.streaming import ingest

TEXTS = ["competition is intense and margins are under pressure", "the cybertruck is a full size electric pickup truck", "headquarters are located in cupertino california"]


@pytest.fixture(scope="module")
def retrieval(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "vec_id long, embedding array<double>")
    return search.Retrieval(docs, vectors)


def ask(spark, text, vector=None):
    return spark.createDataFrame([(0, text, vector)], "query_id long, query string, vector array<double>")


def ranked(spark, lists):
    return [spark.createDataFrame([(0, d, r) for r, d in enumerate(x, 1)], "query_id long, doc_id long, rank int") for x in lists]


def fused(spark, lists):
    return [r.doc_id for r in search.reciprocal_rank_fusion(ranked(spark, lists)).orderBy("rank").collect()]


def test_fusion(spark):
    assert fused(spark, [[1, 7, 3], [2, 7, 4]])[0] == 7
    rows = search.reciprocal_rank_fusion(ranked(spark, [[10, 11, 12]])).orderBy("rank").collect()
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and len({r.score for r in rows}) == 3
    assert fused(spark, [[1, 2, 3], [3, 2, 1]])[0] in (1, 3)
    with pytest.raises(ValueError):
        search.reciprocal_rank_fusion([])


def test_modes(spark, retrieval):
    assert retrieval.search(ask(spark, "x", [0.0, 1.0, 0.0]), 1, "dense").first().doc_id == 1
    assert retrieval.search(ask(spark, "cybertruck"), 1, "bm25").first().doc_id == 1
    found = retrieval.search(ask(spark, "cupertino headquarters", [0.0, 0.0, 1.0]), 2, "hybrid").collect()
    assert len(found) == 2 and 2 in {r.doc_id for r in found} and {r.retrieval_mode for r in found} == {"hybrid"}
    with pytest.raises(ValueError, match="semantic"):
        retrieval.search(ask(spark, "x"), 1, "semantic")


def test_bm25_against_plain_python(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    query = "w1 w1 w5 zzz"
    tokens = [t.split() for t in texts]
    avg = sum(map(len, tokens)) / len(tokens)
    df = {w: sum(w in t for t in tokens) for w in vocab}
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items() if n}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if x < 0 else x for w, x in raw.items()}
    score = lambda t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split())
    wanted = sorted(((round(-score(t), 9), i) for i, t in enumerate(tokens)))[:20]
    hits = search.bm25_topk(search.build_sparse_index(docs), ask(spark, query), docs, 20).orderBy("rank").collect()
    assert [r.doc_id for r in hits] == [i for _, i in wanted]
    assert [r.score for r in hits] == pytest.approx([-s for s, _ in wanted], abs=1e-8)


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "query_id long, vector array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.dense_topk(vectors, asked, 4).collect()}
    assert got == {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(np.argsort(-(x @ x[i]).round(9), kind="stable")[:4])}


def metrics(spark, hits, gold, k=5, **question):
    names = {"eval_k": "int", "question_type": "string"}
    q = spark.createDataFrame([(0, *question.values())], "query_id long" + "".join(f", {n} {names[n]}" for n in question))
    h = spark.createDataFrame([(0, d, r) for r, d in enumerate(hits, 1)], "query_id long, doc_id long, rank int")
    g = spark.createDataFrame([(0, d) for d in gold], "query_id long, doc_id long")
    return evaluate.per_query_metrics(q, h, g, k).first()


def test_metrics(spark):
    m = metrics(spark, [1, 2], [1, 2])
    assert (m.precision_at_k, m.hit_at_k, m.reciprocal_rank, m.question_type) == (1, 1, 1, "known-item")
    m = metrics(spark, [3, 4, 1], [1])
    assert m.precision_at_k == pytest.approx(1 / 3) and m.reciprocal_rank == pytest.approx(1 / 3)
    m = metrics(spark, [3, 4], [1])
    assert (m.precision_at_k, m.hit_at_k, m.reciprocal_rank) == (0, 0, 0)
    m = metrics(spark, [], [1])
    assert (m.precision_at_k, m.hit_at_k) == (0, 0)
    m = metrics(spark, [1, 2, 3, 4, 5], [1])
    assert (m.max_precision_at_k, m.precision_at_k, m.precision_attainment) == (0.2, 0.2, 1.0)
    assert metrics(spark, [2, 1], [1], eval_k=1).precision_at_k == 0
    m = metrics(spark, [1], [])
    assert (m.max_precision_at_k, m.precision_attainment) == (0, 0)


def test_latency(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 4.0)], "s string, value double")
    rows = {r.s: r for r in evaluate.latency_summary(df, "s").collect()}
    assert (rows["a"].p50_ms, rows["a"].p95_ms, rows["a"].n) == (10.5, 19.0, 20)
    assert (rows["b"].p95_ms, rows["b"].qps) == (4.0, 250.0)


@pytest.mark.parametrize(
    "answer, cited, flag",
    [
        ("Revenue rose [1].", [1], "cited"),
        ("Revenue rose【2】.", [2], "cited"),
        ("Two segments【1†L1-L4】【2†L1-L3】", [1, 2], "cited"),
        ("Revenue rose sharply last year.", [], "UNGROUNDED"),
        ("I cannot answer this from the provided documents.", [], "refused"),
        ("Claim [9].", [], "UNGROUNDED"),
        ("A [2]. B [1]. C [2].", [1, 2], "cited"),
        (None, [], "UNGROUNDED"),
    ],
)
def test_faithfulness(spark, answer, cited, flag):
    r = spark.createDataFrame([(answer,)], "a string").select(*(c.alias(n) for n, c in answers.faithfulness(F.col("a"), F.lit(3)).items())).first()
    assert (r.citations, r.faithfulness_flag) == (cited, flag)


def test_answer_scores(spark):
    rows = [("Total net sales were $416,161 million", "Total net sales were $416,161 million"), ("nothing", "Total net sales"), ("x", ""), ("I cannot answer this from the provided documents.", "a b c")]
    s = answers.score_answers(spark.createDataFrame(rows, "generated_answer string, reference_answer string"))
    got = s.collect()
    assert [r.key_fact_recall for r in got] == [1.0, 0.0, 0.0, 0.0] and got[3].refused
    total = answers.answer_summary(s).first()
    assert (total.refused, total.answered) == (1, 3) and total.lexical_accuracy == pytest.approx(1 / 3)
    refused = answers.answer_summary(s.where("refused")).first()
    assert refused.lexical_accuracy == 0.0
    terms = s.select(answers.key_terms(F.col("generated_answer")).alias("t")).first().t
    assert "416,161" in terms or "$416,161" in terms
    assert reports.accuracy_report(s) == "answers have not been judged"
    judged = s.withColumn("judge", answers.parse_verdict(F.lit("It is incorrect")))
    assert reports.accuracy_report(judged).first().correct_share == 1.0
    assert s.select(answers.parse_verdict(F.lit("maybe?")).alias("v")).first().v == "UNPARSED"


def test_prompt_and_generation(spark):
    asked = spark.createDataFrame([(0, "why?"), (1, "who?")], "query_id long, query string")
    hits = spark.createDataFrame([(0, 1, "AAPL", "10-K", "2025-10-31", "Item 1A. Risk Factors", "text", 1.0)], "query_id long, rank int, ticker string, form string, filing_date string, section string, text string, score double")
    prompts = {r.query_id: r.prompt for r in answers.prompts(asked, hits).collect()}
    assert prompts[0] == "SOURCES:\n[1] (AAPL 10-K, 2025-10-31, section: Item 1A. Risk Factors)\ntext\n\nQUESTION: why?\n\nANSWER:"
    assert "QUESTION: who?" in prompts[1]
    out = {r.query_id: r for r in generation.generate_answers(asked, hits, [("none", None), ("echo", lambda p: "As shown [1].")]).collect()}
    assert out[0].faithfulness_flag == "cited" and out[1].faithfulness_flag == "UNGROUNDED" and out[0].provider == "echo"
    pauses = []

    def broken(prompt):
        raise OSError("busy")

    with pytest.raises(RuntimeError, match="busy"):
        generation.ask("x", [("a", broken)], pause=pauses.append)
    assert pauses == [4.0, 8.0, 16.0]


def test_remap(spark):
    q = [("q1", "Where is Apple's corporate headquarters located?", "Cupertino, California.", "d", "2. Properties", "old"), ("q2", "x?", "nothing alike whatsoever", "d", "gone", "old"), ("q3", "x?", "y", "absent", "s", "old")]
    questions = spark.createDataFrame(q, "id string, query string, reference_answer string, gold_doc_id string, gold_section string, gold_chunk_id string")
    chunks = spark.createDataFrame([("d", "c0", "1. Business", 0, "we make phones"), ("d", "c1", "2. Properties", 1, "corporate headquarters is located in cupertino, california.")], "doc_id string, chunk_id string, section string, pos int, text string")
    rows = {r.id: r for r in answers.guarded_remap(questions, chunks).collect()}
    assert (rows["q1"].chunk_id, rows["q1"].outcome) == ("c1", "changed")
    assert rows["q2"].outcome == "unresolved" and "overlap" in rows["q2"].reason
    assert rows["q3"].reason == "no chunk of its document is left"


def test_embedding_cache(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return embedding.hashed_encoder(texts, 4)

    df = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "pos int, text string")
    path = str(tmp_path)
    first = {r.text: r.embedding for r in embedding.encode_cached(df(["a", "bb", "a"]), path, "org/m", encoder).collect()}
    assert seen.value == 2 and len(first["a"]) == 4
    again = embedding.encode_cached(df(["bb", "ccc", "a"]), path, "org/m", encoder).orderBy("pos").collect()
    assert seen.value == 3 and again[0].embedding == first["bb"] and again[2].embedding == first["a"]
    stats = embedding.cache_stats(df(["a", "a", "new"]), embedding.load_cache(spark, path, "org/m"), "org/m").first()
    assert (stats.total, stats.unique_texts, stats.cached, stats.to_embed, stats.hit_rate) == (3, 2, 1, 1, 0.5)
    cold = embedding.cache_stats(df(["a", "b"]), embedding.load_cache(spark, path, "other"), "other").first()
    assert (cold.cached, cold.to_embed, cold.hit_rate) == (0, 2, 0.0)
    assert embedding.cache_stats(df(["a"]).limit(0), embedding.load_cache(spark, path, "m"), "m").first().hit_rate == 0.0
    prefixed = embedding.encode(df(["a"]), "text", is_query=True).first().embedding
    plain = embedding.encode(df([embedding.QUERY_PREFIX + "a"]), "text").first().embedding
    assert prefixed == plain and sum(x * x for x in prefixed) == pytest.approx(1, abs=1e-5)


def test_artifacts_and_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build the index"):
        files.load_artifacts(spark, str(tmp_path / "none"), ["chunks"])
    df = spark.createDataFrame([(0, "x")], "pos int, text string")
    files.save_artifacts({"chunks": df}, str(tmp_path / "index"))
    assert files.load_artifacts(spark, str(tmp_path / "index"), ["chunks"])["chunks"].collect() == df.collect()
    files.write_result({"a": 1}, str(tmp_path / "r.json"))
    assert reports.load_results(spark, str(tmp_path / "r.json")).first().a == 1
    assert reports.load_results(spark, str(tmp_path / "no.json")) is None
    remapped = spark.createDataFrame([("q", "c9", "s", "changed")], "id string, chunk_id string, section string, outcome string")
    path = str(tmp_path / "eval.json")
    assert files.rewrite_eval_set(remapped, [{"id": "q", "gold_chunk_id": "c1", "gold_section": "s"}], path, True)
    assert json.load(open(path))[0]["gold_chunk_id"] == "c9"
    assert not files.rewrite_eval_set(remapped.withColumn("outcome", F.lit("unresolved")), [], path, True)


def test_files_to_texts(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hi</p>")
    (tmp_path / "b.txt").write_text("body\n@subject\nS\n@ann\n")
    (tmp_path / "c.csv").write_text("x")
    rows = {r.doc_id: r for r in files.extract_texts(files.read_files(spark, str(tmp_path))).collect()}
    assert (rows["a"].text, rows["b"].text, rows["c"].text) == ("Hi", "Subject: S\nbody", None) and "unsupported" in rows["c"].error


def test_http():
    calls, pauses = [], []

    def flaky(url, headers, timeout):
        calls.append(headers["User-Agent"])
        if len(calls) < 3:
            raise OSError("503")
        return b"ok"

    assert http.get("u", "me", transport=flaky, pause=pauses.append) == b"ok"
    assert calls == ["me"] * 3 and pauses == [1.5, 3.0, 0.4]
    with pytest.raises(OSError):
        http.get("u", "me", 2, lambda *a: (_ for _ in ()).throw(OSError("x")), pauses.append)
    page = "<table><tr><th>a</th></tr><tr><td>1</td><td>d</td><td><a href='/x'>ex10.htm iXBRL</a></td><td>EX-10.1</td></tr><tr><td>2</td><td>d</td><td>p.pdf</td><td>EX-97</td></tr></table>"
    assert http.find_exhibits(page) == [("ex10.htm", "EX-10.1", "contract")]


def test_http_source_keeps_errors(spark):
    http.register(spark)
    r = spark.read.format("http_documents").option("urls", "nowhere://x").load().first()
    assert r.content is None and r.error


def test_corpus(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, g string")
    assert sorted(r.id for r in corpus.cap_per_group(df, "g", ["id"], 2).collect()) == [0, 1, 2, 3]
    a = [r.id for r in corpus.seeded_sample(df, 4, 42, "id").collect()]
    assert a == [r.id for r in corpus.seeded_sample(df.repartition(5), 4, 42, "id").collect()]
    kept = corpus.gold_subset(df, spark.createDataFrame([("a",)], "g string"), ["g"], 7, 1, "id").collect()
    assert len(kept) == 7 and sum(r.g == "a" for r in kept) == 5
    sub = spark.createDataFrame([("1", ["8-K", "10-K", "10-K"], ["d1", "d2", "d3"], ["n1", "n2", "n3"], ["p1", "p2", "p3"])], "cik string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>")
    assert [r.filingDate for r in corpus.latest_filings(sub, "10-K", 1).collect()] == ["d2"]
    m = corpus.with_fetch_metadata(spark.createDataFrame([("x", "a/b.HTM")], "content string, local_path string")).first()
    assert m["format"] == "htm" and len(m.sha256) == 64
    assert corpus.distinct_first(df, "g", "id").count() == 2


def test_stream_ingests_each_content_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a   b"), (2, "a   b"), (3, "c")], schema).write.parquet(src)
    for _ in range(2):
        q = ingest.ingest(ingest.distinct_documents(ingest.new_documents(spark, src, schema)), out, ck)
        q.awaitTermination()
        spark.createDataFrame([(4, "c"), (5, "d")], schema).write.mode("append").parquet(src)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a b", "c", "d"]
