"""Line dedup, near-duplicate documents, near-duplicate embeddings and components."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE
from textloom.llm import embedding_dedup, line_dedup, near_dedup
from textloom.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def groups(links, vertices):
    parent = {v: v for v in vertices}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in vertices}


# --- components


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    rest = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    links = chain + star + rest
    got = {r.v: r.c for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = groups(links, {v for e in links for v in e})
    assert got == {v: c for v, c in wanted.items() if any(v in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_lines(rows, edits, chars):
    places = [(i, n, line) for i, t in rows for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    places.sort(key=lambda p: p[:2])
    dropped = {}
    for k, (i, n, line) in enumerate(places):
        if any(line == x or (len(line) >= chars and len(x) >= chars and distance(line, x) <= edits) for _, _, x in places[:k]):
            dropped.setdefault(i, []).append(n)
    return dropped


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup_against_brute_force(spark, edits):
    rng = random.Random(edits)
    letters = "abcdé "
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(14, 24))) for _ in range(12)]

    def edited(line):
        line = list(line)
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randrange(len(line))
            kind = rng.randrange(3)
            line[at : at + (kind < 2)] = [rng.choice(letters)] if kind != 1 else []
        return "".join(line)

    texts = ["\n".join(rng.choice([edited(rng.choice(bases)), "short", ""]) for _ in range(5)) for _ in range(30)]
    out = line_dedup.line_verdicts(docs(spark, texts), max_edits=edits, near_chars=12).collect()
    assert {r.doc_id: r.dropped for r in out if r.dropped} == brute_lines(list(enumerate(texts)), edits, 12)


def brute_word_lines(rows):
    places = sorted((i, n, line) for i, t in rows for n, line in enumerate(t.split("\n")) if line.strip(" "))
    dropped = {}
    for k, (i, n, line) in enumerate(places):
        for _, _, x in places[:k]:
            a, b = line.split(), x.split()
            shorter = min(len(line), len(x))
            if line == x or distance(line, x) <= (2 if shorter >= 40 else 1 if shorter >= 20 else 0) or distance(a, b) <= max(len(a), len(b)) // 10:
                dropped.setdefault(i, []).append(n)
                break
    return dropped


def test_line_dedup_budget_grows_with_the_line(spark):
    rng = random.Random(11)
    bases = [[rng.choice(WORDS[:60]) * rng.randint(1, 3) for _ in range(n)] for n in (5, 9, 10, 11, 19, 20, 33, 40, 75)]

    def edited(words):
        words = list(words)
        for _ in range(rng.randint(0, len(words) // 10 + 2)):
            at = rng.randrange(len(words))
            kind = rng.randrange(3)
            words[at : at + (kind < 2)] = [] if kind == 1 else [rng.choice(WORDS)]
        return " ".join(words)

    texts = ["\n".join(edited(rng.choice(bases)) for _ in range(4)) for _ in range(40)]
    texts += ["the extraordinarily long committee sat on the matter all day", "the long committee sat on the matter all day", "one short line of text here", "one short lane of text here"]
    rows = list(enumerate(texts))
    wanted = brute_word_lines(rows)
    assert wanted != brute_lines(rows, 2, 40) and wanted[41] and wanted[43]
    out = line_dedup.line_verdicts(docs(spark, texts)).collect()
    assert {r.doc_id: r.dropped for r in out if r.dropped} == wanted


@pytest.mark.parametrize("crowd", [0, 4])
def test_crowded_keys_leave_out_no_pair(spark, monkeypatch, crowd):
    rng = random.Random(crowd)
    vocabulary = [f"{w}{i}" for i in range(8) for w in WORDS]
    bases = [[rng.choice(vocabulary[:n]) for _ in range(n)] for n in (12, 23, 40, 89, 91)]
    bases.append(["the"] * 30)

    def edited(words):
        words = list(words)
        for _ in range(rng.choice([0, 1, len(words) // 10, len(words) // 10 + 1, len(words) // 10 + 2])):
            at = rng.randrange(len(words))
            kind = rng.randrange(5)
            if kind == 4:
                words[at], words[-1] = words[-1], words[at][:-1] + "x"
            else:
                words[at : at + (kind < 3)] = [] if kind == 1 else [rng.choice(vocabulary)]
        return " ".join(words)

    texts = ["\n".join(edited(rng.choice(bases)) for _ in range(3)) for _ in range(50)]
    dropped = lambda: {r.doc_id: r.dropped for r in line_dedup.line_verdicts(docs(spark, texts)).collect() if r.dropped}
    # every line paired with every other of its keys
    monkeypatch.setattr(line_dedup, "CROWD", 1 << 40)
    wanted = dropped()
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    assert wanted and dropped() == wanted


def test_near_copies_that_their_head_leaves_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"{rng.choice(WORDS)}{i}" for i in range(87)]

    def edited(k):
        words = list(base)
        for at in rng.sample(range(87), k):
            words[at] = f"new{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [" ".join(base), *(edited(rng.choice([2, 9, 10])) for _ in range(240))]
    paired = []
    real = line_dedup.stored

    def counted(df, name, **held):
        out = real(df, name, **held)
        if name == "line_rest" and "a" in df.columns:
            paired.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    lost = {r.doc_id for r in line_dedup.line_verdicts(docs(spark, texts)).collect() if r.n_dropped}
    assert lost == {i for i, t in enumerate(texts) if 0 < sum(a != b for a, b in zip(t.split(), base, strict=True)) <= 8}
    assert len(paired) == 1 and paired[0] <= 10 * len(texts)


def test_dedup_lines_rebuilds_texts(spark):
    rows = ["keep me here\nand me too\n\nlast", "and me too\nnew line\n", "and me too", "one\none\ntwo"]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out == {0: rows[0], 1: "new line\n", 3: "one\ntwo"}


def test_line_edges(spark, edge, empty):
    out = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_verdicts(edge).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (6, 1, 0), (7, 1, 1), (8, 1, 0), (None, 1, 0)} <= out
    assert line_dedup.line_verdicts(edge).count() == len(EDGE)
    kept = line_dedup.dedup_lines(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 1
    assert line_dedup.line_verdicts(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


# --- near-duplicate documents


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert near_dedup.aligned(a, b, 100) == row[-1]


def test_records_bound_the_alignment():
    rng = random.Random(5)
    code = lambda words: near_dedup.labelled(near_dedup.shingle_codes(near_dedup.word_codes([w.encode() for w in words])))
    head = [rng.choice(WORDS[:60]) for _ in range(120)]
    members = []
    for _ in range(12):
        words = list(head)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        members.append(words)
    rows = [near_dedup.record(code(head), code(m)) for m in members]
    n = np.array([len(m) - 4 for m in members])
    keys = [bytes([i]) for i in range(len(members))]
    xs = ys = np.arange(len(members))
    first = xs[:, None] < ys[None, :]
    sure, open_ = near_dedup.linked_members(*(list(c) for c in zip(*rows, strict=True)), n, keys, xs, ys, first)
    similar = {(x, y) for x in range(12) for y in range(x + 1, 12) if near_dedup.similarity_of(" ".join(members[x]), " ".join(members[y])) >= near_dedup.SIMILARITY}
    assert set(sure) <= similar and similar
    assert groups(sure + [p for p in open_ if p in similar], range(12)) == groups(similar, range(12))


def variants(rng, base, n, rate):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, int(rate * len(base)))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(WORDS)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("part", [2048, 7])
def test_near_dedup_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART_ROWS", part)
    rng = random.Random(7)
    texts = []
    for size in (40, 12, 3, 1, 1):
        texts += variants(rng, [rng.choice(WORDS) for _ in range(150)], size, 0.05)
    texts += [texts[0], texts[0].upper(), "one two", "one two", "", None, "!!"]
    rng.shuffle(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similarity_of(texts[i], texts[j]) >= near_dedup.SIMILARITY]
    wanted = groups(links, range(len(texts)))
    out = near_dedup.near_classes(docs(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in out} == wanted
    kept = {r.doc_id for r in near_dedup.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i, c in wanted.items() if i == c}


def test_near_edges(spark, edge, empty):
    out = near_dedup.near_classes(edge).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r.class_id for r in out}
    assert by[7] == by[6] == 6 and by[1] == 1 and by[2] == 2 and by[4] == 4 and by[None] is None
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 1
    assert near_dedup.near_classes(empty).count() == 0


# --- near-duplicate embeddings


@pytest.mark.parametrize("rows", [4096, 9])
def test_embeddings_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    x = np.vstack([base[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.08, 0.16]) for i in range(150)])
    x[5] = x[4] * 3
    label = [int(v) for v in rng.integers(0, 2, 150)]
    table = [(i, v.tolist(), label[i]) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(150) for j in range(i) if label[i] == label[j] and u[i] @ u[j] >= 0.98]
    comp, n = groups(links, range(150)), [sum(i in e for e in links) for i in range(150)]
    out = embedding_dedup.embedding_links(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (n[i], comp[i]) for i in range(150)}


def test_every_pair_is_within_budget_in_some_block():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((500, 24))
    b = a + rng.standard_normal((500, 24)) * 0.15
    u, w = embedding_dedup.unit(a) @ embedding_dedup.rotation(24), embedding_dedup.unit(b) @ embedding_dedup.rotation(24)
    near = (u * w).sum(1) >= 0.98
    shares = np.add.reduceat((u - w) ** 2, embedding_dedup.edges_of(24)[:-1], axis=1)
    assert near.any() and (shares <= embedding_dedup.budgets(24, 0.98) + 1e-9).any(1)[near].all()


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [1.0, None], 1),
        (10, [nan, 1.0], 1), (11, [inf, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [5.0], 3), (14, [7.0], 3), (15, [-7.0], 3),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, vid string, k1 string")
    out = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_links(df).collect()]
    assert len(out) == len(rows)
    got = dict((a, (b, c)) for a, b, c in out)
    assert got[1] == got[2] == got[3] == (2, 1)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 15)) and got[None] == (0, None)
    assert got[13] == got[14] == (1, 13)
    assert embedding_dedup.embedding_classes(df.limit(0)).count() == 0


def test_a_pair_of_very_long_lines_is_compared_in_time(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(20_000)]
    other = list(words)
    for i in range(0, 20_000, 400):
        other[i] = f"new{i}"
    rows = spark.createDataFrame([(1, " ".join(words), " ".join(other)), (2, " ".join(words), " ".join(w + "x" for w in words)), (3, "a b a c", "a b a c")], "i int, a string, b string")
    pair = lambda df: {r.i: r.near for r in df.select("i", line_dedup._within_words(F.split("a", " "), F.split("b", " "), 10).alias("near")).collect()}
    pair(rows.where("i = 3"))
    began = time.perf_counter()
    assert pair(rows) == {1: True, 2: False, 3: False}
    assert time.perf_counter() - began < 8


def test_words_are_coded_alike(spark):
    rng = random.Random(6)
    lists = [([rng.choice("abcdefgh") for _ in range(rng.randrange(12))], [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]) for _ in range(60)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(lists)], "i int, a array<string>, b array<string>").select("i", line_dedup._coded(F.col("a"), F.col("b")).alias("c"))
    for r in got.collect():
        words, codes = [*lists[r.i][0], *lists[r.i][1]], r.c.a + r.c.b
        assert len(codes) == len(words) and len(set(zip(words, codes, strict=True))) == len(set(words)) == len(set(codes)) and len(r.c.a) == len(lists[r.i][0])
