"""Decontamination, SentencePiece, quotation linking, the pipeline, and the guard around them."""

import itertools
import random
import re
import time

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, LONG
from textloom.llm import decontaminate, quote_links, sentencepiece_lattice, sql
from textloom.llm.common import words_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def items(spark, texts):
    return spark.createDataFrame([(f"b{i}", t) for i, t in enumerate(texts)], "item_id string, text string")


# --- decontamination


def brute_hits(text, benchmark, window=10):
    words, hit, found = words_of(text), set(), set()
    for name, item in benchmark:
        own = words_of(item)
        for s in range(max(1, len(own) - window + 1)):
            w = own[s : s + window]
            for p in range(len(words) - len(w) + 1) if w else ():
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("slices", [200_000, 5])
def test_decontamination_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", slices)
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [text(n) for n in (3, 8, 10, 14, 30, 30)] + ["", None, "Only-Once, here"]
    texts = [text(rng.randint(0, 200)) for _ in range(20)] + [f"x {bench[4].upper()} y {bench[4]}", bench[3], f"{bench[5]} {bench[5]}", "only once HERE", bench[4][:25], None, ""]
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs(spark, texts), items(spark, bench)).collect()}
    assert out == {i: brute_hits(t, [(f"b{k}", b) for k, b in enumerate(bench)]) for i, t in enumerate(texts)}


def test_proximity(spark):
    bench = items(spark, ["alpha bravo charlie"])
    df = docs(spark, ["charlie x bravo y alpha", "alpha one two three four five charlie bravo", "alpha bravo charlie"])
    near = decontaminate.occurrences(df, bench, slack=2)
    assert {r.id for r in near.collect()} == {0, 2}
    assert {r.id for r in decontaminate.occurrences(df, bench).collect()} == {2}


def test_proximity_against_every_place(spark):
    rng = random.Random(21)
    vocabulary = ["a", "b", "c", "d", "e", "f"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    phrases = ["a a b", "f e d", "b c b", "d d d"]
    counts = {w: sum(t.split().count(w) for t in texts) for w in vocabulary}

    def wanted(words, phrase, slack):
        n = len(phrase)
        off = min(range(n), key=lambda i: (counts[phrase[i]], phrase[i], i))
        for pos, w in enumerate(words):
            around = words[max(0, pos - n + 1 - slack) : pos + n + slack]
            if w == phrase[off] and all(phrase.count(x) <= around.count(x) for x in phrase):
                yield pos - off

    for slack in (0, 2):
        out = decontaminate.occurrences(docs(spark, texts), items(spark, phrases), slack=slack).collect()
        got = sorted((r.id, r.start, i) for r in out for i in r["items"])
        assert got == sorted((k, s, f"b{j}") for k, t in enumerate(texts) for j, p in enumerate(phrases) for s in wanted(t.split(), p.split(), slack))


def test_decontamination_edges(spark, edge, empty):
    bench = items(spark, ["one two three four five six seven eight nine ten", "日本語"])
    out = decontaminate.contamination(edge, bench).collect()
    assert len(out) == len(EDGE) and {r.doc_id for r in out if r.contaminated} == {6, 7, 9}
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 4
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(edge, bench.limit(0)).collect())
    assert decontaminate.contamination_digest(edge, bench).count() == len(EDGE)


# --- SentencePiece


def test_encoding_equals_the_library_and_round_trips(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for _, t in EDGE] + ["x" * 3000 + " " + "=" * 200, "  two  spaces \n\n tab\there", "naïve ²./ def f(x):\n    return 'a1'", "Zażółć gęślą jaźń 🎉🎉", " "]
    df = docs(spark, texts)
    out = {r.id: r.ids for r in sentencepiece_lattice.encode(df, MODEL).collect()}
    assert out == {i: sp.encode(t) for i, t in enumerate(texts) if t}
    decoded = sentencepiece_lattice.decode(sentencepiece_lattice.encode(df, MODEL), MODEL, ["id"])
    assert {r.id: r.text for r in decoded.collect()} == {i: " " + t for i, t in enumerate(texts) if t}
    summary = {r.doc_id: (r.n_tokens, r.round_trip) for r in sentencepiece_lattice.encoding_summary(df, MODEL).collect()}
    assert summary == {i: (len(sp.encode(t)) if t else 0, True) for i, t in enumerate(texts)}


def test_rare_units_come_back_by_the_shuffle(spark, monkeypatch):
    df = docs(spark, ["the the the cat", "a cat sat on the mat", LONG[:2000]])
    whole = sorted(map(tuple, sentencepiece_lattice.encoding_summary(df, MODEL).collect()))
    for size in (0, 2):
        monkeypatch.setattr(sentencepiece_lattice, "DICTIONARY", size)
        assert sorted(map(tuple, sentencepiece_lattice.encoding_summary(df, MODEL).collect())) == whole


def test_viterbi_fold_finds_the_best_path(spark):
    scores = {"a": -3.0, "b": -3.0, "ab": -4.0, "abc": -9.0, "c": -2.5, "bc": -3.5}
    pieces = sentencepiece_lattice.Pieces({p: (i, s) for i, (p, s) in enumerate(scores.items())}, {i: p.encode() for i, p in enumerate(scores)}, None, 99, True, False, 3, sentencepiece_lattice.BY_SPACE)
    unknown = -20.0

    def best(word):
        table = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            options = []
            for s in range(max(0, e - 3), e):
                if word[s:e] in scores:
                    options.append((table[s][0] + scores[word[s:e]], table[s][1] + [pieces.ids[word[s:e]][0]]))
                elif e == s + 1:
                    options.append((table[s][0] + unknown, table[s][1] + [99]))
            table[e] = max(options, key=lambda o: o[0])
        return table[-1][1]

    units = spark.createDataFrame([("abcab",), ("xab",), ("c",), ("bcbcaab",)], "unit string")
    lattice = sentencepiece_lattice.lattice(units, pieces)
    n = F.length("unit")
    got = lattice.select("unit", sentencepiece_lattice.ids_between(F.col("edges"), sentencepiece_lattice.viterbi_borders(F.col("edges"), n, unknown), F.col("unit"), n, pieces).alias("ids")).collect()
    assert {r.unit: r.ids for r in got} == {u: best(u) for u in ("abcab", "xab", "c", "bcbcaab")}


def test_merges_in_one_pass_equal_merges_by_heap(spark):
    rng = random.Random(5)
    late = flagged = 0
    for round_ in range(4):
        parts = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(30)} | {"a", "b", "c"}
        order = sorted(parts, key=lambda p: (len(p) if round_ % 2 else 0, rng.random()))
        ids = {p: (i, -float(i // 2)) for i, p in enumerate(order)}
        pieces = sentencepiece_lattice.Pieces(ids, {i: p.encode() for p, (i, _) in ids.items()}, None, 99, False, False, 5, sentencepiece_lattice.BY_SPACE)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(60)})
        n = F.length("unit")
        longer = F.filter("edges", lambda x: x["inner"] != 0)
        edges = sentencepiece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "unit string"), pieces)
        once = F.shiftright(sentencepiece_lattice.borders_in_one_pass(longer, n), sentencepiece_lattice.AGAIN_BIT)
        got = edges.select("unit", sentencepiece_lattice.ids_between(F.col("edges"), sentencepiece_lattice.merged_borders(longer, n), F.col("unit"), n, pieces).alias("ids"), once.alias("again"), F.exists("edges", lambda x: x["late"]).alias("late")).collect()
        assert {r.unit: r.ids for r in got} == {w: sentencepiece_lattice.heap_merge(w, pieces) for w in words}
        late, flagged = late + sum(r.late for r in got), flagged + sum(r.again != 0 for r in got)
    assert late and flagged


def test_encoding_edges(spark, edge, empty):
    out = sentencepiece_lattice.encoding_summary(edge, MODEL).collect()
    assert len(out) == len(EDGE) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    six = [tuple(r)[1:] for r in out if r.doc_id in (6, 7)]
    assert len(six) == 3 and len(set(six)) == 1
    assert sentencepiece_lattice.encoding_summary(empty, MODEL).count() == 0


# --- quotation linking


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I install the package on linux?"),
        (1, 1, "assistant", "Use the package manager of your system."),
        (1, 2, "user", "On Monday Bob wrote:\n> How do I install\n> the package on Linux?\nSame question here."),
        (1, 3, "assistant", ">> how do i install the package on linux\n> Same question here.\nAnswered above."),
        (1, 4, "user", "> this was never said by anyone\nHm."),
    ]
    out = {r.turn: r for r in quote_links.replies(talk(spark, rows)).collect()}
    assert [out[t].reply_to for t in range(5)] == [None, 0, 0, 2, 3]
    assert (out[2].text, out[2].n_quotes, out[2].n_linked) == ("Same question here.", 1, 1)
    assert (out[3].text, out[3].n_quotes, out[3].n_linked) == ("Answered above.", 2, 2)
    assert (out[4].text, out[4].n_quotes, out[4].n_linked) == ("Hm.", 1, 0)
    whole = quote_links.conversations(talk(spark, rows)).first()
    assert whole.reply_order == "0,1,2,3,4" and ">" not in whole.chat.replace("|>", "")
    parts = quote_links.conversations(talk(spark, rows), part_turns=2).orderBy("part").collect()
    assert [p.reply_order for p in parts] == ["0,1", "2,3", "4"]


def test_partial_and_short_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Sounds good"),
        (1, 1, "user", "First we met. Then Dr. Who left the room! (Nobody knew why.) It rained."),
        (1, 2, "user", "line one here\nline two here\nline three here"),
        (1, 3, "user", "Paragraph one is\nwrapped.\n\nParagraph two.\n\nParagraph three."),
        (1, 4, "user", "that sounds good to me"),
        (1, 5, "user", "> Sounds good\nYes."),
        (1, 6, "user", "> Nobody knew\n> why.\nYes."),
        (1, 7, "user", "> line two here\n> line three here\nYes."),
        (1, 8, "user", "> Paragraph one is wrapped.\n>\n> Paragraph two.\nYes."),
        (1, 9, "user", "> Then Dr. Who left the room! (Nobody knew why.)\nYes."),
        (1, 10, "user", "> It rained\n\n> line one\nYes."),
        (1, 11, "user", ">\nYes."),
        (2, 12, "user", "> Sounds good\nOther conversation."),
    ]
    out = {r.turn: (r.reply_to, r.n_quotes, r.n_linked) for r in quote_links.replies(talk(spark, rows)).collect()}
    assert {t: out[t] for t in range(5, 13)} == {5: (0, 1, 1), 6: (1, 1, 1), 7: (2, 1, 1), 8: (3, 1, 1), 9: (1, 1, 1), 10: (1, 2, 1), 11: (10, 1, 0), 12: (None, 1, 0)}


def test_replies_stand_after_what_they_answer(spark):
    rng = random.Random(6)
    said = [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(5)) for _ in range(40)]
    rows = [(2, t, "user", (f"> {said[rng.randrange(t)]}\n" if t and rng.random() < 0.6 else "") + said[t]) for t in range(40)]
    order = [int(x) for x in quote_links.conversations(talk(spark, rows)).first().reply_order.split(",")]
    replies = {r.turn: r.reply_to for r in quote_links.replies(talk(spark, rows)).collect()}
    assert all(order.index(r) < order.index(t) for t, r in replies.items() if r is not None)


def test_random_conversations_equal_every_run_of_units(spark, monkeypatch):
    monkeypatch.setattr(quote_links, "SPAN", 32)
    rng = random.Random(12)
    common = ["Yes.", "Sounds good!", "I think that we should wait.", "I think that we should go (now).", "Why?"]

    def message(before):
        own = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 7))).capitalize() + rng.choice([".", "?", "!", "", '."']) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randint(1, 6))]
        text = "".join(x + rng.choice([" ", "\n", "\n\n", "  "]) for x in own)
        for _ in range(rng.randint(0, 2) if before else 0):
            units = re.split(r"(?<=[.!?])\s+|\n+", rng.choice(before))
            start = rng.randrange(len(units))
            quoted = " ".join(units[start : start + rng.randint(1, 3)]).split(" ")
            if rng.random() < 0.2:
                quoted = quoted[1:]
            marks = rng.choice([">", "> ", ">>", "> > "])
            head = rng.choice(["", "", "On Monday Bob wrote:\n"])
            text = f"{head}{marks}{(' ' if rng.random() < 0.7 else chr(10) + marks).join(quoted)}\n" + text
        return text

    rows = []
    for conv, n in ((1, 300), (2, 40), (3, 40), (4, 5)):
        said = []
        for turn in range(n):
            text = message(said)
            said.append("\n".join(x for x in text.split("\n") if not x.startswith(">") and not x.endswith("wrote:")))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(5, 0, "user", "One. Two. Three.\n" * 700), (5, 1, "user", "> One. Two. Three.\n" * 3000 + "long"), (5, 2, "user", "> One. Two. Three. One. Two.\nshort")]
    out = quote_links.chat_digest(talk(spark, rows))
    got = {(r.conv_id, r.part): r.asDict() for r in out.collect()}
    with duckdb.connect() as db:
        db.register("conversations", pa.table({"conv_id": [r[0] for r in rows if r[0] < 5], "turn": [r[1] for r in rows if r[0] < 5], "role": [r[2] for r in rows if r[0] < 5], "text": [r[3] for r in rows if r[0] < 5]}))
        wanted = {(r["conv_id"], r["part"]): r for r in db.execute(sql.CHAT_QUOTES).to_arrow_table().to_pylist()}
    assert {k: v for k, v in got.items() if k[0] < 5} == wanted and (1, 1) in wanted
    assert sum(r["n_linked"] for r in wanted.values()) > 100 and sum(r["n_quotes"] - r["n_linked"] for r in wanted.values()) > 20
    assert (got[5, 0]["n_quotes"], got[5, 0]["n_linked"], got[5, 0]["reply_order"]) == (2, 1, "0,1,2")


def test_quote_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", ">"), (None, 3, "user", "x"), (2, None, "user", "x"), (3, 7, "user", "> " * 500 + "deep"), (4, 0, "user", LONG)]
    df = talk(spark, rows).withColumns({c: F.lit("x") for c in ("own", "unit", "source", "n", "k")})
    out = {(r.conv_id, r.turn): r for r in quote_links.replies(df).collect()}
    assert set(out) == {(1, 0), (1, 1), (1, 2), (3, 7), (4, 0)}
    assert (out[1, 0].role, out[1, 0].text, out[3, 7].text, out[3, 7].reply_to) == ("user", "", "", None)
    assert quote_links.chat_digest(df.limit(0)).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path, edge):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = sentence(20)
    base = sentence(200)
    near = base.split()
    near[50] = "changed"
    rows = [(i, sentence(60), "en", "s", 0) for i in range(40)] + [(50, f"{sentence(30)} {leak} {sentence(30)}", "en", "s", 0), (51, base, "en", "s", 0), (52, " ".join(near), "en", "s", 0), (53, None, "en", "s", 0), (54, "12345", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, [leak]).write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
            out.write.parquet(str(tmp_path / f"{name}.out"))
            df = spark.read.parquet(str(tmp_path / f"{name}.out"))
    assert {r.doc_id for r in df.collect()} == {*range(40), 51}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {*range(40), 51}


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_ends_of_many_units(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        words = [f"u{i % 37}" for i in range(n)]
        got = spark.createDataFrame([(words,)], "u array<string>").select(quote_links.unit_ends(F.col("u")).alias("e")).first().e
        assert got == list(itertools.accumulate((len(w) + 1 for w in words), initial=-1))[1:]


def test_a_message_of_forty_thousand_sentences(spark):
    long = " ".join(f"Point {i} of the list is settled." for i in range(40_000))
    rows = [(1, 1, "user", long), (1, 2, "assistant", "> Point 39998 of the list is settled. Point 39999 of the list is settled.\nGood."), (1, 3, "user", "> Point 7 of the list is settled.\n> > not said\nWhy?")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    got = {r.turn: (r.reply_to, r.n_quotes, r.n_linked) for r in quote_links.replies(messages).collect()}
    assert got == {1: (None, 0, 0), 2: (1, 1, 1), 3: (1, 2, 1)} and time.perf_counter() - began < 40
