"""Versioned tables, chunk runs, PDF pages, validation of broken files, exhibits and worker objects."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import chunk_store, chunking, embedding, pdf, quality
from textloom.operators.extract import render_table
from textloom.sources import files, http
from textloom.sources.versions import Versions


# --- versions


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    numbers = lambda df: sorted(r.n for r in df.collect())
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    assert numbers(table.read("a", "n int")) == [] and table.numbers() == []
    assert table.append("a", frame(1, 2)) == 1 and table.append("a", frame(3)) == 2
    before = table.read("a", "n int")
    half = table.write("a", frame(9))  # a writer that never commits
    assert numbers(table.read("a", "n int")) == [1, 2, 3]
    table.replace("a", before.where("n <> 2").union(frame(4)))
    assert numbers(before) == [1, 2, 3] and numbers(table.read("a", "n int")) == [1, 3, 4] and numbers(table.read("a", "n int", version=1)) == [1, 2]
    table.append("b", frame(7))
    table.compact("a", "n int", "n")
    assert len(table.segments()["a"]) == 1 and numbers(table.read("a", "n int")) == [1, 3, 4] and numbers(table.read("b", "n int")) == [7]
    table.forget()
    assert table.numbers() == [5] and numbers(table.read("a", "n int")) == [1, 3, 4] and half not in table.segments()["a"]
    with pytest.raises(Exception, match="(?i)exist"):
        spark.createDataFrame([("a", "x")], "name string, segment string").write.mode("error").json(str(tmp_path / "t/versions/5"))


def test_cache_is_replaced_in_one_step(spark, tmp_path):
    path, texts = str(tmp_path / "cache"), spark.createDataFrame([(f"text {i}",) for i in range(20)], "text string")
    ones = lambda x: np.ones((len(x), 2), np.float32)
    embedding.encode_cached(texts, path, "m", ones, slices=4)
    reader = embedding.load_cache(spark, path, "m")
    assert len(embedding.cache_of(spark, path, "m").segments()["vectors"]) == 1 and reader.count() == 20
    embedding.replace_cache(reader.limit(5).union(reader.limit(5)), path, "m")
    assert reader.count() == 20 and embedding.load_cache(spark, path, "m").count() == 5


# --- chunk runs

META = ("company", "form")


def files_of(spark, texts):
    return spark.createDataFrame([(i, f"{i}.{f}", bytearray(t.encode()), f, c) for i, (t, f, c) in texts.items()], "doc_id string, path string, content binary, format string, company string")


def test_a_run_writes_changed_files_only(spark, tmp_path):
    store = chunk_store.ChunkStore(spark, str(tmp_path / "store"))
    long = " ".join(f"Sentence number {i} tells something of interest." for i in range(200))
    first = {"a": (long, "txt", "A"), "b": ("Short text of b.", "txt", "B"), "c": ("<p>Page of c.</p>", "html", "C"), "d": ("%PDF", "pdf", "D")}
    assert store.update(files_of(spark, first)).first().asDict() == {"run": 1, "unchanged": 0, "written": 4, "failed": 1, "removed": 0}
    opened = store.chunks()
    n = opened.count()
    second = {"a": first["a"], "b": ("Another text of b.", "txt", "B"), "d": first["d"], "e": ("New text.", "txt", "E")}
    assert store.update(files_of(spark, second)).first().asDict() == {"run": 2, "unchanged": 2, "written": 2, "failed": 0, "removed": 1}
    rows = store.chunks().collect()
    runs = defaultdict(set)
    for r in rows:
        runs[r.doc_id].add(r.run)
    assert runs == {"a": {1}, "b": {2}, "e": {2}} and opened.count() == n
    assert {r.doc_id: r.error for r in store.documents().collect() if r.error}["d"].startswith("RuntimeError")
    fresh = chunk_store.ChunkStore(spark, str(tmp_path / "fresh"))
    fresh.update(files_of(spark, second))
    key = lambda found: sorted((r.chunk_id, r.chunk_index, r.word_count, r.section, r.text, r.embed_text) for r in found)
    assert key(rows) == key(fresh.chunks().collect())
    changed = second | {"a": (long, "txt", "Other name")}  # metadata counts as well
    assert store.update(files_of(spark, changed)).first().written == 1
    assert store.update(files_of(spark, changed | {"c": first["c"]})).first().written == 1  # what was removed comes back
    store.compact()
    after = store.chunks().collect()
    assert {r.doc_id for r in after} == {"a", "b", "c", "e"} and len({r.chunk_id for r in after}) == len(after)
    assert store.versions.read("chunks", chunk_store.CHUNKS).count() == len(after)
    assert store.update(files_of(spark, changed).limit(0)).first().removed == 5 and store.chunks().count() == 0


# --- PDF pages


def brute_page_texts(words, tables, gap):
    out = defaultdict(list)
    keys = sorted({(d, p) for d, p, *_ in words} | {(d, p) for d, p, *_ in tables})
    for doc, page in keys:
        boxes = [t for t in tables if t[:2] == (doc, page)]
        own = [w for w in words if w[:2] == (doc, page) and not any(b[3] <= (w[2] + w[3]) / 2 <= b[4] and b[5] <= (w[4] + w[5]) / 2 <= b[6] for b in boxes)]
        lines, last = [], None
        for w in sorted(own, key=lambda w: (w[4], w[2], w[6])):
            if last is None or w[4] - last > gap:
                lines.append([])
            lines[-1].append((w[2], w[4], w[6]))
            last = w[4]
        out[doc] += [" ".join(t for *_, t in sorted(line)) for line in lines]
        for b in sorted(boxes, key=lambda b: b[2]):
            out[doc] += render_table(b[7]).split("\n")
    return {d: "\n".join(x.strip() for x in lines if x.strip()) for d, lines in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_pdf_pages(spark, seed):
    rng = random.Random(seed)
    words, tables = [], []
    for doc in range(4):
        for page in range(3):
            for _ in range(rng.randrange(3)):
                x, y = rng.randrange(0, 300, 10), rng.randrange(0, 100, 5)
                tables.append((doc, page, len(tables), float(x), float(x + 120), float(y), float(y + 30), [["k", "v"], ["$", str(rng.randrange(9))]]))
            for _ in range(rng.choice([0, 5, 60])):
                x, y = rng.randrange(0, 400, 5), rng.randrange(0, 120) + rng.choice([0, 0.5])
                words.append((doc, page, float(x), float(x + 20), float(y), float(y + 8), f"w{rng.randrange(99)}"))
    got = pdf.page_texts(
        spark.createDataFrame(words, "doc_id int, page int, x0 double, x1 double, top double, bottom double, text string").repartition(3),
        spark.createDataFrame(tables, "doc_id int, page int, table_no int, x0 double, x1 double, top double, bottom double, rows array<array<string>>"),
    )
    assert {r.doc_id: r.text for r in got.collect()} == brute_page_texts(words, tables, pdf.LINE_GAP)


def test_table_symbols():
    assert render_table([["Area", "Sum", "Share"], ["North", "$", "12", "3", "%"], ["South", "$", "7", "4", "%"]]).split("\n")[2] == "| North | $12 | 3% |"
    assert render_table([["$", "$", "5"], ["a", "b", "c"]]).split("\n")[0] == "| $ | $5 |  |"
    assert render_table([["only"], ["lines"]]) == "only\nlines" and render_table([]) == render_table([["", " "]]) == "" and render_table([["a", "", "b"]]) == "a b"


# --- validation, exhibits, tokenizers


def test_broken_files_become_reports(spark):
    rows = [("a.txt", bytearray(b"A line of plain words that says enough. " * 30), "txt", "email"), ("b.pdf", bytearray(b"%PDF"), "pdf", "policy"), ("c.doc", bytearray(b"?"), "doc", None), ("d.txt", bytearray(b"tiny"), "txt", "policy")]
    found = files.extract_texts(spark.createDataFrame(rows, "path string, content binary, format string, doc_type string")).withColumn("length", F.octet_length("content"))
    reports = quality.validate(found.drop("content"))
    out = {r.path: r for r in reports.collect()}
    assert [out[p].status for p in sorted(out)] == ["ok", "fail", "fail", "fail"]
    assert out["b.pdf"].issues[0].startswith("extraction raised RuntimeError") and out["c.doc"].issues == ["extraction raised ValueError: unsupported format .doc: c.doc"] and out["b.pdf"].chars == 0
    assert quality.gate(reports) == 1 and quality.gate(reports.where("path = 'a.txt'")) == 0
    levels = {(r.level, r.doc_type, r.status): r.documents for r in quality.summary_sets(reports).collect()}
    assert levels[("all", None, None)] == 4 and levels[("by status", None, "fail")] == 3 and levels[("by type", "policy", None)] == 2 and levels[("by type and status", "email", "ok")] == 1 and levels[("by type", None, None)] == 1


def test_exhibits_are_joined_to_their_page(spark):
    page = "text <table><tr><th>Seq</th></tr><tr><td>1</td><td>x</td><td><a>k.htm</a> iXBRL</td><td>EX-10.3</td><td>9</td></tr>after<tr><td>2</td><td>y</td><td>l.htm</td><td>EX-19</td></tr> behind"
    out = http.exhibits(spark.createDataFrame([(1, page), (2, "none"), (3, None)], "page_id int, html string"))
    assert sorted((r.page_id, r.file_name, r.exhibit_type, r.kind) for r in out.collect()) == [(1, "k.htm", "EX-10.3", "contract"), (1, "l.htm", "EX-19", "policy")]


def test_tokenizers_are_built_once_a_worker(spark, tmp_path):
    log = tmp_path / "built"

    def factory():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda text: len(text)

    def failing():
        raise OSError("no model here")

    df = spark.createDataFrame([(f"word {i}",) for i in range(400)], "t string").repartition(40)
    for _ in range(2):
        assert all(r.n_tokens == len(r.t) for r in chunking.with_built_tokenizer(df, "t", str(log), factory).collect())
    built = log.read_text().split()
    assert len(built) == len(set(built)) < 40
    assert {r.n_tokens for r in chunking.with_built_tokenizer(df, "t", "failing", failing).collect()} == {4}
