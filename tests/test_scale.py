"""Very long texts end soon, indexes and caches outlive their session, and the optional parts may be missing."""

import builtins
import importlib
import sys
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as t
from textloom.operators import chunking, embedding, quality, search, sections
from textloom.session import spread

LINES = [f"Line {i} of a long report tells of item {i % 7} and of nothing else." if i % 5 else f"Annual report, page {i % 50}" for i in range(20_000)]


@pytest.mark.parametrize(
    "name, use",
    [
        ("normalise", lambda x: F.length(t.normalise_text(x))),
        ("measure", lambda x: quality.measure(x, F.lit(10))["boilerplate_ratio"]),
        ("chunks", lambda x: F.size(chunking.chunk_section(x))),
        ("sections", lambda x: F.size(sections.sections(x))),
    ],
)
def test_twenty_thousand_lines(spark, name, use):
    heads = [f"Item {i}. Part Of The Report" if i % 100 == 0 else line for i, line in enumerate(LINES)]
    df = spark.createDataFrame([("\n".join(heads),)], "x string")
    began = time.perf_counter()
    found = df.select(use(F.col("x")).alias("y")).first().y
    # quadratic work would take hours
    assert time.perf_counter() - began < 60
    if name == "normalise":
        assert found < sum(map(len, LINES)) and found > 100_000
    else:
        assert found > 0.1 if name == "measure" else found >= 100


def test_small_inputs_are_dealt_out(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "i").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.i for r in spread(one).collect()) == list(range(100))


def test_index_is_kept_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog ran after the cat"), (3, "fish")], "doc_id long, text string")
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([(0, "cat dog")], "query_id long, query string")
    fresh = search.Retrieval(docs, vectors)
    fresh.index.save(str(tmp_path / "index"))
    again = search.Retrieval(docs, vectors, index=search.SparseIndex.load(spark, str(tmp_path / "index")))
    assert sorted(map(tuple, again.hits(asked, 3, "bm25").collect())) == sorted(map(tuple, fresh.hits(asked, 3, "bm25").collect()))
    with pytest.raises(FileNotFoundError):
        search.SparseIndex.load(spark, str(tmp_path / "none"))


def test_vectors_encoded_before_a_failure_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(f"text number {i}",) for i in range(40)], "text string")
    path, heard = str(tmp_path / "cache"), []

    def failing(texts):
        if any("number 7" == x[5:] for x in texts):
            raise RuntimeError("no more vectors")
        return np.ones((len(texts), 2), np.float32)

    with pytest.raises(Exception, match="no more vectors"):
        embedding.encode_cached(df, path, "m", failing, on_progress=heard.append, slices=8)
    kept = embedding.load_cache(spark, path, "m").count()
    assert 0 <= kept < 40 and heard == sorted(heard) and (not heard or heard[-1] == kept)
    out = embedding.encode_cached(df, path, "m", lambda x: np.ones((len(x), 2), np.float32), slices=8)
    assert out.where("embedding IS NULL").count() == 0 and embedding.load_cache(spark, path, "m").count() == 40


def test_entry_works_where_a_library_of_the_optional_part_is_missing(monkeypatch):
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("textloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.split(".")[0] in ("sentencepiece", "public_tokenizers"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    names = importlib.reload(entry).queries()
    assert "bm25_topk" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names


def test_texts_reach_python_in_small_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    df = spark.range(0, 5000, 1, 1).select("id", F.concat(F.lit("ﬁ"), F.repeat(F.lit("x"), 10)).alias("text"))
    assert df.select(t.nfkc(F.col("text")).alias("t")).distinct().first().t == "fi" + "x" * 10
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= 1000
