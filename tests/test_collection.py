"""Settings, fetching over a transport, and comparing encoders."""

import numpy as np

from textloom.config import Config, doctor
from textloom.operators import compare, embedding
from textloom.sources import fetch


def test_settings_and_doctor(tmp_path):
    (tmp_path / "raw").mkdir()
    config = Config(str(tmp_path), providers=("here", "there"), environment={"HERE_API_KEY": "k", "THERE_API_KEY": " "})
    lines, code = doctor(config)
    assert code == 1 and any(x.endswith("index: MISSING") for x in lines) and "here: key set" in lines and "there: no key" in lines
    for name in ("index", "results"):
        (tmp_path / name).mkdir()
    assert doctor(config)[1] == 0 and doctor(Config("store://bucket"))[1] == 0


def test_filings_are_requested_and_failures_skipped(spark):
    rows = [(7, ["A", "B", "A", "A"], ["d4", "d3", "d2", "d1"], ["0-4", "0-3", "0-2", "0-1"], ["x.htm", "b.htm", "y.htm", "x.htm"]), (8, ["B"], ["d9"], ["0-9"], ["b.htm"])]
    submissions = spark.createDataFrame(rows, "cik int, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>")
    requests = fetch.filing_requests(submissions, {"A": 3, "B": 1}, "http://host/{cik}/{accession}/{document}")
    got = {r.url: (r.form, r.newest) for r in requests.collect()}
    assert got["http://host/7/04/x.htm"] == ("A", True) and got["http://host/7/01/x.htm"] == ("A", False) and len(got) == 5

    def transport(url):
        if "/02/" in url:
            raise TimeoutError("slow")
        return url.encode()

    fetched = fetch.fetch(requests, transport)
    assert [r.error for r in fetched.collect() if r.error] == ["TimeoutError: slow"]
    kept = {r.doc_id: (r.url, r.format) for r in fetch.fetched_documents(fetched, "url").collect()}
    assert kept == {"x": ("http://host/7/01/x.htm", "htm"), "b": ("http://host/7/03/b.htm", "htm")}
    listed = spark.createDataFrame([(1, "http://host/02/p.pdf"), (2, "http://host/q.pdf"), (3, "http://host/r.pdf")], "pos int, url string")
    assert [r.doc_id for r in fetch.fetch_list(listed, transport, "pos", 2).collect()] == ["q"]


def test_models_are_compared(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"word{i} word{i} common") for i in range(12)], "doc_id long, text string")
    questions = spark.createDataFrame([(i, f"word{i}") for i in range(4)], "query_id long, query string")
    gold = spark.createDataFrame([(i, i) for i in range(4)], "query_id long, doc_id long")
    flat = lambda texts: np.ones((len(texts), 3), np.float32)
    good = lambda texts: embedding.hashed_encoder([t.replace(embedding.QUERY_PREFIX, "") for t in texts], 512)
    out = {r.label: r for r in compare.compare_models({"good": good, "flat": flat}, chunks, questions, gold, str(tmp_path)).collect()}
    assert out["good"].mrr == 1.0 and out["flat"].mrr < 1.0 and (out["good"].dim, out["flat"].dim) == (512, 3)
    assert out["good"].chunks_newly_embedded == 12 and out["good"].questions == 4
    again = compare.compare_models({"good": good}, chunks, questions, gold, str(tmp_path)).first()
    assert again.chunks_newly_embedded == 0
