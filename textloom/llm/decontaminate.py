"""Benchmark decontamination over a distributed positional inverted index.

Each window of a benchmark item (ten consecutive words; a shorter item is one window) is
looked up by its rarest word in the corpus. The index holds a posting for every place where
such a word stands: the document, the position, and as payload the words around it, which
stand for the offset-adjusted postings of the window's other words. A window occurs at a
posting when its words equal the payload's at their offsets (exact phrase), or when all of
them stand within a given number of words (proximity).

Scale: documents are read narrowly; only postings of rarest words of windows leave the scan,
and only verified places are shuffled. Windows are broadcast in slices of at most
MAX_WINDOWS, so a benchmark of any size is matched in bounded memory, one pass a slice.

Defined results: a null text has no words; a document without words, and any document when
the benchmark is empty, is not contaminated; items without words have no windows; a null
item id counts as the empty string; repeated rows give repeated results, rows of one id but
different texts are kept apart; texts are matched whole; other input columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import sha256_hex, words_column

WINDOW = 10
#: Windows broadcast at once: about 200 bytes each.
MAX_WINDOWS = 200_000


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: (wid, w_words, items), items being the sorted ids that contain it."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_column(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (
        items.select("item", "all", F.explode(starts).alias("s"))
        .select("item", F.slice("all", F.col("s"), window).alias("w_words"))
        .groupBy("w_words")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("wid", F.xxhash64("w_words"))
    )


def _anchored(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """Adds to each window its rarest word in the corpus (term) and its offset (off).

    A window with a word that the corpus lacks cannot occur and is left out."""
    terms = windows.select("w_words", F.posexplode("w_words").alias("off", "term"))
    corpus = docs.select(F.explode(words_column(F.col(text_col))).alias("term"))
    vocabulary = terms.select("term").distinct()
    frequency = corpus.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    best = (
        terms.join(frequency, "term")
        .groupBy("w_words")
        .agg(F.min(F.struct("n", "term", "off")).alias("best"), F.count("*").alias("known"))
        .where(F.col("known") == F.size("w_words"))
    )
    return windows.join(best, "w_words").select("wid", "w_words", "items", F.col("best.term").alias("term"), F.col("best.off").alias("off"))


def _postings(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str, slack: int | None) -> DataFrame:
    """Postings of the anchors' terms, each beside the window it may belong to.

    around: without slack the words where the window would stand, with slack those that are
    less than the window's length and slack words away from its rarest word."""
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_column(F.col(text_col)).alias("words"))
    places = words.select("id", "h", "words", F.posexplode("words").alias("pos", "term"))
    n = F.size("w_words")
    start = F.col("pos") - F.col("off")
    if slack is None:
        around = F.slice("words", F.greatest(start, F.lit(0)) + 1, n)
    else:
        reach = n - 1 + slack
        around = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, reach + F.least(F.col("pos"), reach) + 1)
    return places.join(F.broadcast(anchors), "term").select("id", "h", start.alias("start"), "wid", "w_words", "items", around.alias("around"))


def _holds(around: Column, words: Column) -> Column:
    """Whether each word stands around at least as often as in the window."""
    times = lambda array, w: F.size(F.filter(array, lambda x: x == w))
    return F.forall(F.array_distinct(words), lambda w: times(words, w) <= times(around, w))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """Places (id, h, start, n, items) where windows occur; h is the text's hash.

    slack None: exact phrases. slack k: proximity, all words of the window in any order, a word
    that stands twice in it twice, each at most its length - 1 + k words from its rarest one; start is then where that one puts it."""
    windows = windows_of(benchmark, text_col="text", window=window)
    slices = max(1, -(-windows.count() // MAX_WINDOWS))
    found = []
    for k in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod(F.col("wid"), F.lit(slices)) == k)
        posted = _postings(docs, _anchored(docs, part, text_col), id_col, text_col, slack)
        if slack is None:
            kept = posted.where((F.col("start") >= 0) & (F.col("around") == F.col("w_words")))
        else:
            kept = posted.where((F.size(F.array_except("w_words", "around")) == 0) & _holds(F.col("around"), F.col("w_words")))
        found.append(kept.select("id", "h", "start", F.size("w_words").alias("n"), "items"))
    return reduce(DataFrame.unionByName, found)


def covered(spans: Column) -> Column:
    """How many positions an array of structs (start, n) covers."""
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(x["start"] + x["n"] - F.greatest(x["start"], acc["to"]), F.lit(0))).cast("bigint").alias("total"),
        F.greatest(acc["to"], x["start"] + x["n"]).alias("to"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: (id, n_words, n_hit, n_items, items, contaminated)."""
    hits = (
        occurrences(docs, benchmark, id_col, text_col, window)
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("id").alias("hit_id"), F.col("h").alias("hit_h"), covered(F.col("spans")).alias("n_hit"), "items")
    )
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.size(words_column(F.col(text_col))).cast("bigint").alias("n_words"))
    return base.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with the item ids as a digest."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, unchanged, in which no window occurs."""
    hit = occurrences(docs, benchmark, id_col, text_col, window).select(F.col("id").alias("__hit_id"), F.col("h").alias("__hit_h")).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(text_col) == F.col("__hit_h")), "left_anti")
