"""Fill-in-the-middle: the automaton against a regular expression, and exact round trips."""

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGE, LONG
from textloom.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, cut_share=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut_share:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, len(units))))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def arranged(texts, ids, cut_share=50):
    return [(*r[:4], r[4].decode()) for r in fill_middle.arranged([t.encode() for t in texts], ids, 42, cut_share, 80)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab <>PSM\t\n\x0b\x1f\x85\xa0é日🎉", max_size=400), min_size=1, max_size=8), st.integers(0, 10**6))
def test_units_and_cuts_equal_those_of_the_pattern(texts, first):
    ids = list(range(first, first + len(texts)))
    assert arranged(texts, ids, 100) == [brute(i, t, 100) for i, t in zip(ids, texts, strict=True)]


def test_texts_of_many_lanes_and_marks_across_lanes():
    rng = random.Random(5)
    texts = [(" " * k + "é" * (k % 5) + "w" * (fill_middle.LANE - k % 7) + "<") + mark for k in range(60) for mark in ("P>", "S >", "M>x", "")]
    texts += ["".join(rng.choice(["a", " ", "\n", "é", "日本", "🎉", "<", "<P", ">", "word "]) for _ in range(5000)) for _ in range(20)]
    assert arranged(texts, list(range(len(texts))), 100) == [brute(i, t, 100) for i, t in enumerate(texts)]


def test_any_three_bytes_fix_the_state():
    after, _ = fill_middle.transitions()
    for kinds in itertools.product(range(9), repeat=fill_middle.SYNC):
        ends = set()
        for state in range(7):
            for kind in kinds:
                state = after[state * fill_middle.CLASSES + kind]
            ends.add(int(state))
        assert len(ends) == 1, kinds


def test_bytes_that_are_no_text_do_not_break_it():
    raw = [b"\x80\x80 a", b"\xff\xfe", b"\xe6\x97", b"a \xf0\x9f b", bytes(range(256)) * 3]
    made = fill_middle.arranged(raw, [1, 2, 3, 4, 5], 42, 100, 80)
    for text, (_, form, _, _, output) in zip(raw, made, strict=True):
        parts = re.split(rb"<[PSM]>", output)
        assert text == (output if form == "plain" else parts[2] + parts[3] + parts[1] if form == "spm" else parts[1] + parts[3] + parts[2])
    assert np.all([n >= 1 for n, *_ in made])


def test_operator_and_digest(spark, edge, empty):
    out = fill_middle.fill_in_middle(edge).collect()
    assert len(out) == len(EDGE)
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out))) == sorted(map(repr, ((i, *brute(i, t)) for i, t in EDGE)))
    digest = fill_middle.fill_digest(edge).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.output_sha256, r.restored_sha256) for r in digest) == sorted((i or 0, sha(brute(i, t)[4]), sha(t)) for i, t in EDGE)
    assert {r.doc_id: r.n for r in digest}[5] == len(LONG.split())
    assert fill_middle.fill_digest(empty).count() == 0


def test_marks_are_never_cut(spark):
    rows = spark.createDataFrame([(i, f"a<b <{'PSM'[i % 3]}> c") for i in range(30)] + [(i, "a <p> < P> b<>") for i in range(30, 60)], "doc_id long, text string")
    forms = {r.doc_id: r.form for r in fill_middle.fill_in_middle(rows, cut_share=100).collect()}
    assert {forms[i] for i in range(30)} == {"plain"} and {forms[i] for i in range(30, 60)} <= {"psm", "spm"}
