"""Pruned BM25 against all scores, metrics by section and exact ranks of values against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate, search


def zipf_texts(rng, n, words):
    weights = [1 / (i + 1) ** 1.3 for i in range(words)]
    return [" ".join(rng.choices([f"w{i}" for i in range(words)], weights, k=rng.choice([0, 3, 12, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 5), (3, 20)])
def test_pruned_scores_hold_the_best(spark, monkeypatch, seed, k):
    monkeypatch.setattr(search, "BLOCK_DOCS", 2)
    rng = random.Random(seed)
    docs = spark.createDataFrame(list(enumerate(zipf_texts(rng, 300, 80))), "doc_id long, text string")
    asked = [(i, " ".join(rng.choices([f"w{j}" for j in range(90)], k=rng.randint(1, 8)))) for i in range(12)]
    asked += [(12, "w0 w1 w0"), (13, "nothing known"), (14, ""), (15, "w79 w0 w1 w2 w3")]
    index = search.build_sparse_index(docs)
    assert index.terms.where("df > 150").count() > 0  # raw idf below zero
    terms = search.query_terms(spark.createDataFrame(asked, "query_id long, query string"), "query_id", "query")
    pruned = search.bm25_pruned(index, terms, k)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in search.top_k(df, k).collect())
    assert key(pruned.scores) == key(search.bm25_scores(index, terms))


def test_frequent_terms_are_scored_for_few_documents(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, f"the of and {' '.join(rng.choices([f'r{j}' for j in range(200)], k=6))}") for i in range(4000)], "doc_id long, text string")
    index = search.build_sparse_index(docs)
    terms = search.query_terms(spark.createDataFrame([(i, f"the of and r{i} r{i + 1} r{i + 2}") for i in range(20)], "query_id long, query string"), "query_id", "query")
    pruned = search.bm25_pruned(index, terms, 5)
    every = index.postings.join(terms, "term").count()
    scored = sum(x.count() for x in pruned[1:])
    assert every > 20 * 3 * 4000 and scored < every / 6
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in search.top_k(df, 5).collect())
    assert key(pruned.scores) == key(search.bm25_scores(index, terms))


def test_section_metrics(spark):
    rng = random.Random(2)
    sections = [("a", "x"), ("a", "y"), ("b", "x"), ("b", None)]
    hits = {q: [rng.choice(sections) for _ in range(rng.choice([0, 4, 25]))] for q in range(30)}
    asked = [(q, *rng.choice([("a", "x"), ("b", "x"), ("c", "z"), (None, None)]), rng.choice([1, 3, 5, None]), rng.choice(["topical", None])) for q in range(30)]
    sizes = {("a", "x"): 2, ("a", "y"): 9, ("b", "x"): 30}
    got = evaluate.section_metrics(
        spark.createDataFrame(asked, "query_id int, gold_doc_id string, gold_section string, eval_k int, question_type string"),
        spark.createDataFrame([(q, d, s, r) for q, found in hits.items() for r, (d, s) in enumerate(found, 1)], "query_id int, doc_id string, section string, rank int"),
        spark.createDataFrame([(*key, n) for key, n in sizes.items()], "doc_id string, section string, size long"),
    )
    rows = {r.query_id: r for r in got.collect()}
    assert len(rows) == 30
    for q, doc, section, k, kind in asked:
        k = k or 5
        match = [h == (doc, section) and doc is not None for h in hits[q]]
        precision = sum(match[:k]) / len(match[:k]) if match else 0.0
        ceiling = min(sizes.get((doc, section), 0), k) / k
        first = next((i for i, m in enumerate(match[: evaluate.MRR_DEPTH], 1) if m), None)
        wanted = (k, kind or "known-item", precision, float(any(match[:k])), ceiling, precision / ceiling if ceiling else 0.0, 1 / first if first else 0.0)
        assert tuple(rows[q])[1:] == pytest.approx(wanted) if not isinstance(kind, str) else tuple(rows[q])[2] == kind
        assert [tuple(rows[q])[1], *tuple(rows[q])[3:]] == pytest.approx([wanted[0], *wanted[2:]])


@pytest.mark.parametrize("seed", range(3))
def test_latency_summary_of_skewed_groups(spark, seed):
    rng = random.Random(seed)
    groups = {"one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 500, "many": [rng.lognormvariate(1, 2) for _ in range(3001)], "few values": [float(rng.randrange(4)) for _ in range(1000)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    rng.shuffle(rows)
    got = {r.g: r for r in evaluate.latency_summary(spark.createDataFrame(rows, "g string, value double").repartition(5), "g").collect()}
    assert got["none"].n == 0 and got["none"].p50_ms is None and got["none"].qps == 0.0
    for g, vs in groups.items():
        vs.sort()
        p50 = statistics.median(vs)
        assert (got[g].n, got[g].p50_ms, got[g].p95_ms, got[g].min_ms, got[g].max_ms) == (len(vs), p50, vs[int(len(vs) * 0.95) - 1], vs[0], vs[-1])
        assert got[g].mean_ms == pytest.approx(statistics.fmean(vs)) and got[g].qps == pytest.approx(1000 / p50 if p50 else 0.0)


def test_no_task_sorts_a_whole_group(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("g"), F.rand(3).alias("value"))
    places = spark.createDataFrame([("all", p) for p in (1, 9_999, 20_000)], "g string, place long")
    found = evaluate.values_at(rows, places, "g", "value")
    wanted = sorted(r.value for r in rows.collect())
    assert {r.place: r.value for r in found.collect()} == {p: wanted[p - 1] for p in (1, 9_999, 20_000)}
    assert "PARTITION BY [g]" not in found._jdf.queryExecution().toString() and evaluate.values_at(rows.limit(0), places, "g", "value").count() == 0


def test_best_of_many_equal_one_sort():
    draw = np.random.default_rng(5)
    best, parts = search.Best(3, 7), []
    for part in range(9):
        scores, among = draw.integers(0, 4, (7, 11)).astype(float), draw.random((7, 11)) < 0.7
        scores += draw.random((7, 11)) * 1e-11  # equal to nine places
        scores[draw.random((7, 11)) < 0.05] = np.nan
        names = np.arange(11) * 9 + part
        best.add(scores, names, among)
        parts += [(q, not np.isnan(scores[q, d]), -scores[q, d].round(9), names[d]) for q, d in zip(*np.nonzero(among), strict=True)]
    wanted = [[x for x in sorted(parts, key=lambda x: (x[0], x[1], 0.0 if not x[1] else x[2], x[3])) if x[0] == q][:3] for q in range(7)]
    assert list(zip(best.query, best.name, strict=True)) == [(q, name) for rows in wanted for q, _, _, name in rows]


def test_passages_are_scored_without_a_row_for_every_query_and_document(spark):
    docs = spark.createDataFrame([(i, f"the r{i % 50} s{i % 7} {'the ' * (i % 5)}") for i in range(1500)] + [(1500, None), (1501, "")], "doc_id long, text string").repartition(2).persist()
    index = search.build_sparse_index(docs)
    asked = [(i, f"the r{i % 60} s{i % 9} s{i % 9} t{i}") for i in range(1200)] + [(1200, None), (1201, "nothing here")]
    terms = search.query_terms(spark.createDataFrame(asked, "query_id long, query string"), "query_id", "query")
    best = search.bm25_best(index, terms, 4)
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.count() <= 4 * 1200 * best.rdd.getNumPartitions() < search.bm25_scores(index, terms).count()
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in search.top_k(df, 4).collect())
    assert key(best) == key(search.bm25_scores(index, terms))


def test_terms_are_counted_within_their_row(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],), (["z"],)], "t array<string>")
    assert [{x.term: x.tf for x in r.c} for r in df.select(search.term_counts(F.col("t")).alias("c")).collect()] == [{"a": 2, "b": 3, "c": 1}, {}, {"z": 1}]


def test_modes_share_their_lists(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 4} w{i % 6}") for i in range(30)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "w1 w2", [1.0, 0.5]), (2, "w5", [-1.0, 1.0])], "query_id long, query string, vector array<double>")
    r = search.Retrieval(docs, vectors)
    key = lambda df: sorted(map(tuple, df.collect()))
    wanted = {mode: key(r.hits(asked, 3, mode)) for mode in search.MODES}
    searches, one = [], search.bm25_topk
    monkeypatch.setattr(search, "bm25_topk", lambda *a, **kw: searches.append(1) or one(*a, **kw))
    assert {mode: key(df) for mode, df in r.hits_by_mode(asked, 3).items()} == wanted and len(searches) == 1
