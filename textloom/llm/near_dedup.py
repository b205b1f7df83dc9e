"""Near-duplicate documents by order MinHash.

A document is the sequence of its five-word shingles, each labelled with how many times it
has occurred before. Each of SKETCHES sketches takes the PICKED least shingles under its own
hash and keeps them in text order; documents that agree in a sketch, order included, become
candidates, so the chance of meeting follows similarity under edits rather than of bags.
Candidates are verified by a banded alignment of their shingle sequences: with m shingles
aligned of n1 and n2, the similarity is m / (n1 + n2 - m), and 0.8 or more links the two.

Scale: documents of equal words are one class from the start (min of id by hash, partial
aggregates), so copies cost nothing further. In a bucket every member is paired with one
representative only, its head. That pair's alignment also tells which of the head's shingles
the member keeps, in order, and which it adds. Members of one head that are still in
different components are then compared by these short records alone: what both keep of the
head is a common subsequence, so it proves links; what they share at most disproves them; the
few pairs in between are aligned by their texts. Heads with many members are dealt out as
pairs of parts; what leaves a part is a spanning forest, never its pairs. Nothing is capped.

Defined results: words are lower-cased in A-Z; a text without words (null, empty, marks
only) is its own class; fewer than five words are one shingle; the class id is the least id
among the documents reached; rows without id get the id of their class, if it has one; rows
of equal id and text share all results; other input columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, ship, stored, words_of
from textloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: 20 sketches of 4. Were the picks independent, a pair of similarity 0.8 would meet with probability
#: 1 - (1 - 0.8**4)**20 > 0.9999; few shingles are picked together, so of texts of 8 and 9 words one pair in 80 is missed.
SKETCHES, PICKED = 20, 4
#: Members of a head that one task compares with as many others.
PART_ROWS = 2048
_rng = np.random.default_rng(5)
SALTS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
#: Shingles ranked at once: bounds a worker's memory for texts of any length.
BLOCK = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def word_codes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def shingle_codes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles; all words are one shingle if they are fewer than size."""
    if not len(codes):
        return codes
    size = min(size, len(codes))
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        h = mixed(h + codes[k : len(codes) - size + 1 + k])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """The shingles told apart by how often each has occurred before."""
    by = np.argsort(h, kind="stable")
    run = h[by]
    new = np.concatenate(([True], run[1:] != run[:-1]))
    if new.all():
        return h
    start = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    out = np.empty_like(h)
    out[by] = mixed(run + (np.arange(len(run)) - start).astype(np.uint64) * MIX)
    return out


def sketches(h: np.ndarray) -> list[int]:
    """The order MinHash of labelled shingles: one signed 64-bit number per sketch."""
    k = min(PICKED, len(h))
    least = np.empty((SKETCHES, 0), np.uint64)
    places = np.empty((SKETCHES, 0), np.int64)
    for s in range(0, len(h), BLOCK):
        ranks = (h[None, s : s + BLOCK] ^ SALTS[:, None]) * MIX
        at = np.argpartition(ranks, min(k, ranks.shape[1]) - 1, axis=1)[:, :k]
        least = np.concatenate((least, np.take_along_axis(ranks, at, 1)), axis=1)
        places = np.concatenate((places, at + s), axis=1)
        if least.shape[1] > k:
            best = np.argpartition(least, k - 1, axis=1)[:, :k]
            least, places = np.take_along_axis(least, best, 1), np.take_along_axis(places, best, 1)
    picked = h[np.sort(places, axis=1)]
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for j in range(k):
        out = mixed(out * MIX + picked[:, j])
    return out.view(np.int64).tolist()


def band(n1: int, n2: int, similarity: float = SIMILARITY) -> int:
    """How far an alignment of at least this similarity can leave the diagonal."""
    least = similarity * (n1 + n2) / (1 + similarity)
    return int(n1 + n2 - 2 * least + 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Length of the longest common subsequence of two sequences inside the band.

    Common ends are taken off first; the rest is a bit-parallel recurrence over b whose rows
    hold only the matches at most width off the diagonal."""
    n = min(len(a), len(b))
    if not n:
        return 0
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else []
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for j, y in enumerate(b.tolist()):
        m = where.get(y, 0)
        if m:
            low = max(0, j - width)
            m = (m >> low << low) & ((1 << (j + width + 1)) - 1)
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def similarity_of(a: str | None, b: str | None) -> float:
    """The alignment similarity of two texts; 0 if either has no words."""
    return similarity_of_codes(shingle_codes(word_codes(words_of(a))), shingle_codes(word_codes(words_of(b))))


def similarity_of_codes(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    m = aligned(x, y, band(len(x), len(y), least))
    return m / (len(x) + len(y) - m)


def increasing(places: np.ndarray) -> np.ndarray:
    """Which elements form a longest increasing run of distinct places (as a subsequence)."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return np.arange(len(places))
    ends: list[int] = []
    at: list[int] = []
    before = np.full(len(places), -1)
    for i, x in enumerate(places.tolist()):
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            at.append(i)
        else:
            ends[k], at[k] = x, i
        before[i] = at[k - 1] if k else -1
    out = [at[-1]]
    while before[out[-1]] >= 0:
        out.append(before[out[-1]])
    return np.array(out[::-1])


def record(head: np.ndarray, own: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """What a member keeps and adds, by labelled shingles: bits of the head's shingles kept in
    order, bits of all kept, and the hashes added, sorted."""
    by = np.argsort(head)
    at = np.minimum(np.searchsorted(head[by], own), len(head) - 1)
    known = head[by][at] == own
    places = by[at[known]]
    full, low = np.zeros(-(-len(head) // 64) * 64, bool), np.zeros(-(-len(head) // 64) * 64, bool)
    full[places] = True
    low[places[increasing(places)]] = True
    return np.packbits(low).tobytes(), np.packbits(full).tobytes(), np.sort(own[~known]).tobytes()


def linked_members(lows: list[bytes], fulls: list[bytes], extras: list[bytes], n: np.ndarray, comps: list[bytes], xs: np.ndarray, ys: np.ndarray, first: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Among the pairs (x, y) of different components with first[x, y]: a spanning forest of the proved links, and the undecided pairs."""
    bits = lambda rows: np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    low, full = bits(lows), bits(fulls)
    added = [np.frombuffer(e, np.uint64) for e in extras]
    names, counts = np.unique(np.concatenate(added), return_counts=True)
    shared = names[counts > 1]
    holds = np.zeros((len(added), len(shared)), np.float32)
    for i, e in enumerate(added):
        at = np.searchsorted(shared, e)
        at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == e)] if len(shared) else at[:0]
        holds[i, at] = 1
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while (p := parent.setdefault(c, c)) != c:
            parent[c] = parent.setdefault(p, p)
            c = parent[c]
        return c

    sure, open_ = [], []
    code = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([code[c] for c in comps])
    for s in range(0, len(xs), 64):
        part = xs[s : s + 64]
        kept = np.bitwise_count(low[part, None, :] & low[None, ys, :]).sum(2, dtype=np.int64)
        most = np.bitwise_count(full[part, None, :] & full[None, ys, :]).sum(2, dtype=np.int64) + (holds[part] @ holds[ys].T).astype(np.int64)
        total = n[part][:, None] + n[ys][None, :]
        wanted = (comp[part][:, None] != comp[ys][None, :]) & first[s : s + 64]
        enough = lambda m: m >= SIMILARITY * (total - m) - 1e-9
        for i, j in zip(*np.nonzero(wanted & enough(kept)), strict=True):
            x, y = int(part[i]), int(ys[j])
            if (p := root(comps[x])) != (q := root(comps[y])):
                parent[p] = q
                sure.append((x, y))
        open_ += [(int(part[i]), int(ys[j])) for i, j in zip(*np.nonzero(wanted & enough(most) & ~enough(kept)), strict=True)]
    return sure, [(x, y) for x, y in open_ if root(comps[x]) != root(comps[y])]


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow pass: (id, h, key, sketches) per row; key stands for the word sequence, null if none."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, sketched = [], []
        for text in b.column(2).to_pylist():
            words = words_of(text)
            keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            sketched.append(sketches(labelled(shingle_codes(word_codes(words)))) if words else [])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sketched, pa.list_(pa.int64()))], names=["id", "h", "key", "sketches"])

    return map_batches(docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)), per_batch, f"id {id_type}, h bigint, key binary, sketches array<bigint>")


def _with_texts(pairs: DataFrame, docs: DataFrame, owners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of keys with their texts; owners: (key, id, h), one row that holds the text."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = owners.join(wanted, "key", "left_semi")
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("dh"), F.col(text_col).alias("text"))
    texts = own.join(rows, F.col("doc").eqNullSafe(F.col("id")) & (F.col("dh") == F.col("h"))).select("key", "text").dropDuplicates(["key"])
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb")


def _aligned(pairs: DataFrame, with_record: bool) -> DataFrame:
    """(a, b, good), good where the texts align; with_record also n, low, full, extra of b against a."""

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, np.ndarray] = {}

        def codes(text: str) -> np.ndarray:
            if text not in known:
                known[text] = shingle_codes(word_codes(words_of(text)))
            return known[text]

        texts = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        out = [pa.array([similarity_of_codes(codes(x), codes(y)) >= SIMILARITY for x, y in texts])]
        names = ["a", "b", "good"]
        if with_record:
            records = [record(labelled(codes(x)), labelled(codes(y))) for x, y in texts]
            out += [pa.array([len(codes(y)) for _, y in texts], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*records, strict=True))]
            names += ["n", "low", "full", "extra"]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], names=names)

    return map_batches(pairs, per_batch, "a binary, b binary, good boolean" + ", n int, low binary, full binary, extra binary" * with_record)


def _between_members(stars: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b, sure) between members of one head that are in different components."""
    rows = (
        stars.select("a", "b", "n", "low", "full", "extra")
        .join(label.select(F.col("key").alias("b"), F.col("c").alias("c")), "b", "left")
        .join(label.select(F.col("key").alias("a"), F.col("c").alias("head_c")), "a", "left")
        .select("a", F.col("b").alias("key"), "n", "low", "full", "extra", F.coalesce("c", "b").alias("c"), F.coalesce("head_c", "a").alias("head_c"))
        .withColumn("out", F.col("c") != F.col("head_c"))
    )
    sizes = rows.groupBy("a").agg(F.count("*").alias("members"), F.max("out").alias("some")).where("some AND members > 1").select("a", F.ceil(F.col("members") / PART_ROWS).cast("int").alias("parts"))
    dealt = rows.join(sizes, "a").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["a", "key", "n", "low", "full", "extra", "c", "out"]
    single = dealt.where("parts = 1").select(*columns, F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("out").alias("as_x"), F.lit(True).alias("as_y"))
    left = dealt.where("parts > 1 AND out").select(*columns, F.col("own").alias("p"), every.alias("q"), F.lit(True).alias("as_x"), F.lit(False).alias("as_y"))
    right = dealt.where("parts > 1").select(*columns, every.alias("p"), F.col("own").alias("q"), F.lit(False).alias("as_x"), F.lit(True).alias("as_y"))

    def per_part(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = np.flatnonzero(pdf.as_x.to_numpy(bool)), np.flatnonzero(pdf.as_y.to_numpy(bool))
        found: list[tuple[bytes, bytes, bool]] = []
        if len(xs) and len(ys):
            keys, out = list(pdf.key), pdf.out.to_numpy(bool)
            order = np.argsort(np.argsort(np.array([k.hex() for k in keys])))
            first = ~out[ys][None, :] | (order[xs][:, None] < order[ys][None, :])
            sure, open_ = linked_members(list(pdf.low), list(pdf.full), list(pdf.extra), pdf.n.to_numpy(), list(pdf.c), xs, ys, first)
            found = [(keys[x], keys[y], True) for x, y in sure] + [(keys[x], keys[y], False) for x, y in open_]
        return pd.DataFrame(found, columns=["a", "b", "sure"])

    return single.unionByName(left).unionByName(right).groupBy("a", "p", "q").applyInPandas(per_part, "a binary, b binary, sure boolean")


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, h, class): class is a key of the component, null without words."""
    ship(docs.sparkSession)
    rows = stored(profiles(docs, id_col, text_col), "profiles")
    texts = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("id", "h")).alias("owner"), F.first("sketches").alias("sketches"))
    owners = texts.select("key", "owner.id", "owner.h")
    members = texts.select("key", F.posexplode("sketches").alias("s", "sketch")).select("key", F.xxhash64("s", "sketch").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("head")).where("size > 1").select("bucket", "head")
    first = stored(members.join(heads, "bucket").where(F.col("key") != F.col("head")).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    stars = stored(_aligned(_with_texts(first, docs, owners, id_col, text_col), True), "stars")
    links = stars.where("good").select("a", "b")
    joined = components(links)
    between = stored(_between_members(stars, joined.withColumnRenamed("v", "key")), "between")
    more = between.where("sure").select("a", "b")
    undecided = between.where("NOT sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not undecided.isEmpty():
        more = more.unionByName(stored(_aligned(_with_texts(undecided, docs, owners, id_col, text_col), False), "aligned").where("good").select("a", "b"))
    final = joined if more.isEmpty() else components(links.unionByName(more))
    return rows.select("id", "h", "key").join(final.withColumnRenamed("v", "key"), "key", "left").select("id", "h", F.coalesce("c", "key").alias("class"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, class_id, kept); class_id is the least id of its class."""
    placed = memberships(docs, id_col, text_col)
    least = placed.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("least"))
    return placed.join(least, "class", "left").select(F.col("id").alias(id_col), F.coalesce("least", "id").alias("class_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unchanged, that are first in their class; repeated rows stay or go together."""
    placed = memberships(docs, id_col, text_col).where(F.col("class").isNotNull())
    first = placed.groupBy("class").agg(F.min(F.struct("id", "h")).alias("first"))
    gone = placed.join(first, "class").where(~F.struct("id", "h").eqNullSafe(F.col("first"))).select(F.col("id").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text_col) == F.col("__gone_h")), "left_anti")
