"""Divergence of sources: the byte tokenizer against a pattern, results against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import source_divergence as audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, by_lang, by_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms_of(text)
        docs[lang].update(set(words))
        by_lang[lang].update(words)
        by_group[lang, source].update(words)
    out = []
    for lang in by_lang:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for (at, s), c in by_group.items() if at == lang}
        q = share(by_lang[lang])
        for s in p:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if by_group[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", item.decode(), -v, r) for r, (v, item) in enumerate(pair, 1)]
            out += [(lang, s, "term", item.decode(), -v, r) for r, (v, item) in enumerate(term[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def table(spark, rows, more=()):
    return spark.createDataFrame([(*r, *("x" for _ in more)) for r in rows], "text string, lang string, source string" + "".join(f", `{c}` string" for c in more)).repartition(3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ@[`{\x7f\x80é日🎉 1_", max_size=30), min_size=1, max_size=6), st.integers(0, 3))
def test_slices_are_those_of_the_pattern(texts, skipped):
    whole = pa.array(["AB"] * skipped + texts, pa.large_string()).slice(skipped)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[skipped : skipped + len(texts) + 1]
    data = whole.buffers()[2]
    terms, of = audit.slices_of(np.frombuffer(data, np.uint8) if data.size else np.zeros(0, np.uint8), offsets)
    assert [(int(d), t.decode()) for t, d in zip(terms.to_pylist(), of, strict=True)] == [(d, w) for d, t in enumerate(texts) for w in terms_of(t)]


def test_equal_hashes_are_told_apart():
    terms = audit.Terms(lambda t: len(t))
    numbers = [terms.number(t) for t in (b"ab", b"cd", b"abc", b"cd", b"ab", b"xyz", b"abc")]
    assert numbers == [0, 1, 2, 1, 0, 3, 2] and terms.slices == [b"ab", b"cd", b"abc", b"xyz"]


def test_divergences_of_sparse_matrices():
    rng = np.random.default_rng(2)
    dense = [np.where(rng.random((n, 40)) < 0.3, rng.integers(1, 10**9, (n, 40)), -1) for n in (5, 7)]
    dense[0][2] = dense[1][0] = -1  # rows without terms, one of them the first
    bases = [rng.integers(1, 1000, len(d)) for d in dense]
    csr = [audit.Csr(*np.nonzero(d >= 0), d[d >= 0], b) for d, b in zip(dense, bases, strict=True)]
    full = [np.where(d >= 0, d, b[:, None]) for d, b in zip(dense, bases, strict=True)]
    for i, value, either in audit.divergences(*csr, 40):
        for j in range(7):
            held = (dense[0][i] >= 0) | (dense[1][j] >= 0)
            assert either[j] == held.sum() and value[j] == np.abs(full[0][i] - full[1][j])[held].sum()


def random_rows(rng, n, sources):
    words = ["alpha", "Beta", "GAMMA", "été", "日本", "z", "naïve"] + [f"w{chr(97 + k)}" for k in range(26)]
    return [(" ".join(rng.choice(words[rng.randrange(3) :]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(2 * sources), sources)}") for _ in range(n)]


@pytest.mark.parametrize(("terms", "sources", "held"), [(1024, 64, 1_000_000), (5, 3, 20)])
def test_equals_plain_counting(spark, monkeypatch, terms, sources, held):
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("HELD_COUNTS", held)):
        monkeypatch.setattr(audit, name, value)
    rows = random_rows(random.Random(4), 500, 9)
    got = audit.source_divergence(table(spark, rows))
    assert rows_of(got) == brute(rows)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_edges(spark):
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "en", "b"), ("only once", "xx", "solo")] + [("same words here", "en", "c")] * 40 + [("same other words", "en", "d")] * 31
    rows += [("the " * 5000 + "x" * 100_000, "en", "e"), ("\x00NUL\x00 Ünï", "en", "b")]
    assert rows_of(audit.source_divergence(table(spark, rows, ("term", "n", "p", "side", "block", "value", "rank")))) == brute(rows)
    assert audit.source_divergence(table(spark, rows).limit(0)).count() == 0


def test_shares_stay_exact_for_large_counts(spark):
    n, total, v = 4_000_000_000_000_000_000, 8_999_999_999_999_999_999, 7
    got = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(audit.share("n", "total", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
