"""Audit of how the sources of a language diverge in the words they use.

Terms are maximal runs of letters and non-ASCII characters, A-Z lower-cased. The tokenizer works on
bytes: a lookup table over the concatenated UTF-8 buffer of a batch marks and lower-cases
term bytes, and where marks begin and end lie the terms, cut also where texts meet. Equal slices are
grouped by hash with comparison of their bytes: by Arrow's hash table within a batch, by
xxhash across a task's batches. What a batch leaves is a CSR matrix of texts by terms, summed to counts
and document frequencies of each (language, source).

A language keeps the terms in at least `least_docs` of its documents. A group's share of a kept term
is p = 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V)), with N the group's count of all V
kept terms. Two sources diverge by the sum of |p - p'| over all kept terms. It is added up from blocks
of TERMS terms by SOURCES x SOURCES sources: the block's counts are CSR matrices, a row of
one meets all rows of the other by gathering and np.add.reduceat, and terms that neither
source holds, which differ by one constant, are counted only.

Scale: one narrow pass over the texts, partial counts of at most HELD_COUNTS rows at a time in a
task, then aggregates by term. A task of the comparison holds one block, at most TERMS x 2 SOURCES counts,
whatever the number of sources and terms. Tables joined to counts are broadcast up to
BROADCAST_ROWS rows, beyond that shuffled.

All arithmetic is exact: 64-bit integers, and decimals where a product may exceed them.

Defined results: null texts, languages and sources are empty ones; a (language, source) without
terms is a group like others; a language without kept terms has pairs of value 0 and no term
rows; a source alone in its language has no pairs; repeated rows count again; other input columns are
ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ship, stored

LEAST_DOCS = 30
UNIT, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: A block of the comparison.
TERMS, SOURCES = 1024, 64
#: Counts that a task gathers before it hands them on.
HELD_COUNTS = 1_000_000
#: Bound on the rows of a broadcast table.
BROADCAST_ROWS = 200_000


def byte_table() -> np.ndarray:
    """Lower-cased byte of a term, 0 for all others."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    letters = np.arange(ord("a"), ord("z") + 1)
    table[letters] = table[letters - 32] = letters
    return table


TABLE = byte_table()


def slices_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The terms of texts that lie one behind the other, offsets saying where, and the text of each."""
    first = offsets[0]
    lowered = TABLE[data[first : offsets[-1]]]
    marks = lowered > 0
    edges = np.zeros(len(marks) + 1, bool)  # where a text begins
    edges[offsets - first] = True
    begins, ends = marks.copy(), marks.copy()
    begins[1:] &= ~marks[:-1] | edges[1:-1]
    ends[:-1] &= ~marks[1:] | edges[1:-1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - starts + 1
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(lowered[marks]))])
    return terms, np.searchsorted(offsets - first, starts, "right") - 1


class Terms:
    """Numbers of distinct slices, found by xxhash; equal hashes are told apart by their bytes."""

    def __init__(self, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        self.digest = digest
        self.at: dict[int, int] = {}
        self.slices: list[bytes] = []

    def number(self, term: bytes) -> int:
        h = self.digest(term)
        while (k := self.at.get(h)) is not None:
            if self.slices[k] == term:
                return k
            h = (h + 1) % 2**64
        self.at[h] = len(self.slices)
        self.slices.append(term)
        return len(self.slices) - 1


class Counts:
    """Counts and document frequencies by (group, term), gathered over batches."""

    def __init__(self):
        self.terms, self.groups = Terms(), {}
        self.keys, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, groups: list[tuple[str, str]], terms: pa.BinaryArray, text_of: np.ndarray) -> None:
        own = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        encoded = terms.dictionary_encode()
        numbers = np.array([self.terms.number(t) for t in encoded.dictionary.to_pylist()], np.int64)
        width = max(1, len(numbers))
        cells, n = np.unique(text_of * width + encoded.indices.to_numpy(), return_counts=True)  # the CSR matrix, row by row
        keys = own[cells // width] << 32 | numbers[cells % width] if len(cells) else cells
        self.merge(keys, n, np.ones(len(n), np.int64))

    def merge(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        keys, n, docs = (np.concatenate(x) for x in ((self.keys, keys), (self.n, n), (self.docs, docs)))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.n, self.docs = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, docs))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs): a row without term for each group, then the counts."""
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in range(2))
        zeros = pa.array(np.zeros(len(self.groups), np.int64))
        names = ["lang", "source", "term", "n", "docs"]
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(self.groups), pa.string()), zeros, zeros], names=names)
        terms = pa.array(self.terms.slices, pa.binary()).view(pa.string())
        for s in range(0, len(self.keys), 10_000):
            keys = self.keys[s : s + 10_000]
            of, term = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms.take(term), pa.array(self.n[s : s + 10_000]), pa.array(self.docs[s : s + 10_000])], names=names)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, lang, source) to partial counts."""
    held = Counts()
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column(0).cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        terms, text_of = slices_of(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets)
        held.add(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), terms, text_of)
        if len(held.keys) >= HELD_COUNTS:
            yield from held.batches()
            held = Counts()
    if held.groups:
        yield from held.batches()


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of a CSR matrix's rows; empty rows give 0."""
    out = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.int64, copy=False), starts[full])
    return out


class Csr:
    """Shares of sources (rows) in terms (columns); base: a row's share of terms that it lacks."""

    def __init__(self, row: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray):
        order = np.argsort(row, kind="stable")
        self.of, self.term, self.p, self.base = row[order], term[order], p[order], base
        self.starts = np.searchsorted(self.of, np.arange(len(base) + 1))


def divergences(left: Csr, right: Csr, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of left: against all rows of right, the sum of |p - p'| over the terms that either holds, and their number."""
    lengths = np.diff(right.starts)
    for i, base in enumerate(left.base):
        own = slice(left.starts[i], left.starts[i + 1])
        dense, held = np.full(width, base, np.int64), np.zeros(width, bool)
        dense[left.term[own]], held[left.term[own]] = left.p[own], True
        met, both = dense[right.term], held[right.term]
        value = row_sums(np.abs(met - right.p), right.starts)
        value += np.abs(left.p[own][:, None] - right.base[None, :]).sum(axis=0)
        value -= row_sums(np.where(both, np.abs(met - right.base[right.of]), 0), right.starts)
        yield i, value, own.stop - own.start + lengths - row_sums(both, right.starts)


def compared(t: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of sources in one block."""
    t = t.combine_chunks()
    is_base = t.column("term").is_null()
    bases, cells = t.filter(is_base), t.filter(pa.compute.invert(is_base))
    names, side = bases.column("source").to_pylist(), bases.column("side").to_numpy()
    number = {name: k for k, name in enumerate(names)}
    sources = cells.column("source").combine_chunks().dictionary_encode()
    rows = np.array([number[s] for s in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()] if len(cells) else np.zeros(0, np.int64)
    terms = cells.column("term").combine_chunks().dictionary_encode()
    term, p, base = terms.indices.to_numpy(), cells.column("p").to_numpy(), bases.column("p").to_numpy()
    a, b, n_terms = (bases.column(c)[0].as_py() for c in ("a", "b", "n_terms"))

    def matrix(of: int) -> tuple[np.ndarray, Csr]:
        own = np.flatnonzero(side == of)
        place = np.full(len(names), -1)
        place[own] = np.arange(len(own))
        mine = place[rows] >= 0
        return own, Csr(place[rows[mine]], term[mine], p[mine], base[own])

    (one, left), (other, right) = matrix(a), matrix(b)
    out: list[tuple] = []
    for i, value, either in divergences(left, right, len(terms.dictionary)):
        wanted = np.arange(i + 1, len(other)) if a == b else np.arange(len(other))
        out.append((np.full(len(wanted), one[i]), other[wanted], value[wanted], either[wanted], np.abs(left.base[i] - right.base[wanted])))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
    listed = pa.array(names, pa.string())
    langs = pa.array([t.column("lang")[0].as_py()] * len(columns[0]), pa.string())
    return pa.table({"lang": langs, "one": listed.take(pa.array(columns[0])), "other": listed.take(pa.array(columns[1])), "value": columns[2], "either": columns[3], "apart": columns[4], "n_terms": np.full(len(columns[0]), n_terms)})


def small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def share(count: str, total: str, terms: str):
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), 0 without terms."""
    return F.expr(f"if({terms} = 0, 0, 1 + (cast({count} + {SMOOTH} as decimal(20, 0)) * {UNIT}BD) div cast({total} + {SMOOTH} * {terms} as decimal(20, 0)))")


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has the other sources by divergence, part term the terms a source overuses."""
    spark = df.sparkSession
    ship(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    partial = df.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source")).mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    used = stored(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    seen = counts.where("term is null").select("lang", "source")
    languages = stored(
        seen.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total")), "lang", "left").select("lang", "n_sources", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")),
        "languages",
    )
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n_blocks, n_sides = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / TERMS)), F.ceil(F.col("n_sources") / SOURCES)
    groups = seen.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))).join(small(languages), "lang")
    groups = stored(groups.select("*", share("0", "total", "n_terms").alias("base"), F.pmod(F.xxhash64("source"), n_sides).alias("side"), n_sides.alias("sides"), n_blocks.alias("blocks")), "groups")
    shares = used.join(small(groups), ["lang", "source"]).withColumn("p", share("n", "total", "n_terms"))

    body = ["lang", "side", "sides", "n_terms", "source"]
    cells = shares.select(*body, "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    bases = groups.select(*body, F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1))
    sent = cells.unionByName(bases).withColumn("with", meets).withColumns({"a": F.least("side", "with"), "b": F.greatest("side", "with")})
    blocks = sent.select("lang", "block", "a", "b", "side", "n_terms", "source", "term", "p").groupBy("lang", "block", "a", "b").applyInArrow(compared, "lang string, one string, other string, value bigint, either bigint, apart bigint, n_terms bigint")
    pairs = blocks.groupBy("lang", "one", "other").agg((F.sum("value") + (F.max("n_terms") - F.sum("either")) * F.max("apart")).alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    pair = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    over = F.col("p") - share("lang_n", "lang_total", "n_terms")
    term = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top_terms))
