"""Exact top-k against all scores, and the bounds that eliminate."""

import random

import numpy as np
import pytest

from textloom.llm import exact_topk


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label int{more}")


def brute(rows, k=5, every=50):
    usable = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in usable]
    out = []
    for q, v in whole:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q and len(w) == len(v))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(rng, n, dim, clusters, spread):
    centres = rng.standard_normal((clusters, dim))
    return [(i, (centres[i % clusters] + spread * rng.standard_normal(dim)).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(3, 0.3), (16, 0.05)])
def test_equals_all_scores(spark, dim, spread):
    rows = clustered(np.random.default_rng(dim), 900, dim, 7, spread)
    got = exact_topk.exact_top_k(vectors(spark, rows), "vec_id % 50 = 0", pivots=6, sample_rows=40, part_rows=60, query_rows=5)
    assert rows_of(got) == brute(rows)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"


def test_ties_copies_and_a_vector_that_a_third_share(spark):
    rng = random.Random(3)
    rows = [(i, [0.5, 0.25, -0.75] if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], 1) for i in range(600)]
    rows += rows[:40]
    rng.shuffle(rows)
    assert rows_of(exact_topk.exact_top_k(vectors(spark, rows), "vec_id % 50 = 0", sample_rows=20, part_rows=50, query_rows=4)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [2.0, 1.0], 1), (50, None, 1), (100, [nan, 1.0], 1), (150, [1.0, None], 1), (200, [inf, 0.0], 1), (None, [1.0, 1.0], 1), (250, [], None), (251, [], None), (300, [0.0, 0.0], 2)]
    rows += [(350, [-0.001, 3.0], 1), (-50, [1.0, 1.0], 1), (7, [1.0, 1.0, 1.0], 1), (400, [1e6, -1e6], None), (401, [-1e6, 1e6], None), (450, [1.0] * 4, 1)]
    clash = vectors(spark, [(*r, "x", "y", 3) for r in rows], ", id string, v string, part int")
    assert rows_of(exact_topk.top_five(clash)) == brute(rows)
    assert exact_topk.top_five(clash.limit(0)).count() == 0
    assert exact_topk.top_five(vectors(spark, [(50, [1.0], 1)])).count() == 0


def test_scores_stay_exact_beyond_doubles(spark):
    rows = [(0, [5e6, 1.0, 0.5], 1), (1, [5e6, 1.0, 0.25], 1), (2, [5e6, 1.0, 0.5], 1), (3, [5e6, 1.0078125, 0.5], 1), (4, [-5e6, 1.0, 0.0], 1)]
    assert rows_of(exact_topk.top_five(vectors(spark, rows))) == brute(rows)
    with pytest.raises(OverflowError):
        exact_topk.scores(np.array([[1e18, 0.0]]), np.array([[1e18, 0.0]]))


def test_pivots_end_the_search_early():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * np.array([v for _, v, _ in clustered(rng, 4000, 8, 40, 0.02)]))
    norms, ids = np.linalg.norm(rows, axis=1), np.arange(len(rows))
    pivots = exact_topk.farthest_first(rows[:400], 32)
    table = exact_topk.angles(rows, norms, pivots)
    assert len(np.unique(pivots, axis=0)) == 32
    evaluated = 0
    for i in range(0, 4000, 100):
        found, values, n = exact_topk.best_of(rows[i], norms[i], table[i], -np.inf, i, 5, rows, norms, np.ascontiguousarray(table.T), ids)
        want = sorted((-int(s), j) for j, s in enumerate(rows @ rows[i]) if j != i)[:5]
        assert list(zip(values.tolist(), found.tolist(), strict=True)) == [(-s, j) for s, j in want]
        evaluated += n
    assert evaluated < 0.25 * 40 * 4000


def test_groups_are_packed():
    assert exact_topk.packed({(2, 0): 3, (2, 1): 4, (2, 2): 25, (2, 3): 1, (3, 0): 1}, 10, True) == {(2, 0): (0, 1), (2, 1): (0, 1), (2, 2): (1, 3), (2, 3): (4, 1), (3, 0): (5, 1)}
    assert exact_topk.packed({(2, 0): 3, (2, 1): 14}, 10, False) == {(2, 0): (0, 1), (2, 1): (1, 2)}
