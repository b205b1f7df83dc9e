"""Language ID by interpolated Kneser-Ney character models, one per language.

A model is fitted on a bounded sample of labelled rows: per language about SAMPLE_DOCS
documents and SAMPLE_CHARS characters, TOTAL_CHARS at most in all, drawn by a hash of the id
and the text (whole texts, none longer than its language's share; where all are, the shortest).
Every language has one text at least. Each model
is a few sorted arrays of n-gram hashes with their log probabilities and back-off weights. A text is scored whole:
its n-grams are hashed in vectors, the distinct ones looked up by binary search, and the
language with the least cross-entropy per character wins. Rejection is calibrated on a part
of the sample that the models do not see: a text is rejected when even its best model finds
it far less likely than that language's own texts of its length.

Scale: counting rows per language is one partial aggregate; prediction is one narrow pass in
bounded Arrow batches, at most CHUNK characters at a time. Model size depends on the sample.

Defined results: null, empty and letterless texts are `und` with score 0 and rejected;
without any labelled row every text is; ties go to the alphabetically first language;
a null id counts as the empty string for the folds; other input columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches

ORDER = 4
#: Bounds of the labelled sample, per language.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1_500_000
#: Characters of all languages' samples together, which the driver holds.
TOTAL_CHARS = 100_000_000
#: Learned languages at most.
MAX_LANGUAGES = 500
#: The hash that draws texts is taken modulo this.
DRAWN = 1_000_000
#: Nats per character above a language's own mean below which no text is rejected: passages in
#: another language, keys or addresses inside a text raise its cross-entropy by less.
MARGIN = 1.5
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
PAD, SPACE = 1, 32


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes_of(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points; every run of other characters is one space. Empty if no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[raw]
    if not is_letter.any():
        return raw[:0]
    out = np.where(is_letter, raw, np.uint32(SPACE))
    return out[is_letter | np.concatenate(([True], is_letter[:-1]))]


def padded(codes: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate((np.full(order - 1, PAD, np.uint32), codes))


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of code points; columns from the first character to the last."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64) + np.uint64(1)) * MIX
        h ^= h >> np.uint64(29)
    return h


class Model(NamedTuple):
    """grams[k], logp[k]: sorted hashes of (k+1)-grams and their log probabilities;
    contexts[k], gamma[k]: the same for the back-off weights of their contexts."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    gamma: list[np.ndarray]
    unseen: float


def find(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of h in a sorted array."""
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == h


def fit(texts: list[np.ndarray], order: int = ORDER) -> Model:
    """An interpolated Kneser-Ney model of padded texts: raw counts at the highest order,
    counts of distinct left neighbours below, one discount per order."""
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, order) for t in texts]) if texts else np.zeros((0, order), np.uint32)
    kinds: list[tuple[np.ndarray, np.ndarray]] = []
    _, first, count = np.unique(hashed(list(rows.T)), return_index=True, return_counts=True)
    grams = rows[first]
    for k in range(order, 0, -1):
        kinds.append((grams, count))
        if k > 1:
            _, first, count = np.unique(hashed(list(grams[:, 1:].T)), return_index=True, return_counts=True)
            grams = grams[first, 1:]
    out = Model([], [], [], [], 0.0)
    below_h, below_p = np.zeros(0, np.uint64), np.zeros(0)
    floor = 0.0
    for k, (grams, count) in enumerate(reversed(kinds), 1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = hashed(list(grams[:, :-1].T)) if k > 1 else np.zeros(len(grams), np.uint64)
        names, inverse = np.unique(context, return_inverse=True)
        total, types = np.bincount(inverse, count, len(names)), np.bincount(inverse, minlength=len(names))
        weight = discount * types / np.maximum(total, 1)
        if k == 1:
            floor = float(weight[0] / (len(grams) + 1)) if len(grams) else 1e-6
            lower = np.full(len(grams), floor)
        else:
            at, _ = find(below_h, hashed(list(grams[:, 1:].T)))
            lower = below_p[at] * weight[inverse]
        p = np.maximum(count - discount, 0) / total[inverse] + lower if len(grams) else np.zeros(0)
        h = hashed(list(grams.T))
        by = np.argsort(h)
        below_h, below_p = h[by], p[by]
        out.grams.append(below_h)
        out.logp.append(np.log(below_p))
        out.contexts.append(names)
        out.gamma.append(np.log(weight))
    return out._replace(unseen=float(np.log(floor)))


def log_probabilities(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """ln P(last character | the ones before) of each row of a full order's code points."""
    at, seen = find(model.grams[0], hashed(columns[-1:]))
    out = np.where(seen, model.logp[0][at] if len(model.logp[0]) else model.unseen, model.unseen)
    for k in range(2, len(columns) + 1):
        at, seen = find(model.grams[k - 1], hashed(columns[-k:]))
        where, known = find(model.contexts[k - 1], hashed(columns[-k:-1]))
        if len(model.gamma[k - 1]):
            out = np.where(seen, model.logp[k - 1][at], out + np.where(known, model.gamma[k - 1][where], 0.0))
    return out


def cross_entropies(models: list[Model], texts: list[np.ndarray], order: int = ORDER) -> np.ndarray:
    """Nats per character of each text (not padded, each with at least one letter) under each model."""
    total = np.zeros((len(texts), len(models)))
    group: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not group:
            return
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(piece, order) for _, piece in group])
        owner = np.repeat([i for i, _ in group], [len(piece) - order + 1 for _, piece in group])
        which, _ = pd.factorize(hashed(list(grams.T)))
        first = np.zeros(which.max() + 1, np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        columns = list(grams[first].T)
        for m, model in enumerate(models):
            total[:, m] += np.bincount(owner, log_probabilities(model, columns)[which], len(texts))
        group.clear()

    held = 0
    for i, codes in enumerate(texts):
        whole = padded(codes, order)
        for s in range(0, len(codes), CHUNK):
            piece = whole[s : s + CHUNK + order - 1]
            group.append((i, piece))
            held += len(piece)
            if held >= CHUNK:
                flush()
                held = 0
    flush()
    return -total / np.array([[len(c)] for c in texts])


class Recogniser(NamedTuple):
    langs: list[str]
    models: list[Model]
    mean: np.ndarray
    spread: np.ndarray
    reach: np.ndarray

    def limits(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of n characters is rejected as language best."""
        return self.mean[best] + np.maximum(self.reach[best] * self.spread[best] / np.sqrt(n), MARGIN)


def train(sample: list[tuple[str, str]], order: int = ORDER) -> Recogniser:
    """Fits models on four fifths of (lang, text) and calibrates rejection on the rest."""
    texts: dict[str, list[np.ndarray]] = {}
    for lang, text in sorted(sample):
        if len(codes := codes_of(text)):
            texts.setdefault(lang, []).append(codes)
    langs = sorted(texts)
    models, mean, spread, reach = [], [], [], []
    for lang in langs:
        own = texts[lang]
        kept = [c for i, c in enumerate(own) if i % 5 or len(own) < 5]
        model = fit([padded(c, order) for c in kept], order)
        apart = [c for i, c in enumerate(own) if i % 5 == 0]
        x = cross_entropies([model], apart, order)[:, 0]
        n = np.array([len(c) for c in apart])
        mu = float(np.average(x, weights=n))
        s = float(np.sqrt(np.mean((x - mu) ** 2 * n))) or 1.0
        models.append(model)
        mean.append(mu)
        spread.append(s)
        reach.append(max(6.0, 1.5 * float(np.max((x - mu) * np.sqrt(n) / s))))
    return Recogniser(langs, models, np.array(mean), np.array(spread), np.array(reach))


def held_out(id_col: str) -> Column:
    """The fold that is never learned from: crc32 of the id as text divides by five."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, text) of the labelled rows outside the held-out fold that are learned from.

    Rows are drawn by a hash of id and text, equal ones once; of those drawn, as many as fit the language's characters are
    taken in the order of that hash. The first row of a language is always among them, cut to that size if it is longer."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = labelled.groupBy(lang_col).agg(F.count("*").alias("n"), F.sum(F.length(text_col)).alias("chars")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return []
    most = min(SAMPLE_CHARS, TOTAL_CHARS // len(sizes))
    hashed = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.length(text_col).alias("size"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("h"))
    place = F.pmod("h", F.lit(DRAWN))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, SAMPLE_DOCS / r["n"], most / max(1, r["chars"])))])
    drawn = hashed.where((F.col("size") <= most) & (place / DRAWN < F.element_at(share, F.col("lang")))).select("lang", "h", "size", place.alias("place")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, 0)
    taken = drawn.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= most).select("lang", "h")
    long = F.col("size") > most
    first = hashed.groupBy("lang").agg(F.min(F.struct(long.alias("long"), F.when(long, F.col("size")).otherwise(0).alias("size"), place.alias("place"), "h")).alias("x")).select("lang", "x.h")
    wanted = taken.unionByName(first).distinct()  # at most some multiple of SAMPLE_DOCS a language
    texts = hashed.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.first(F.substring("text", 1, most)).alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"]))]


def fit_recogniser(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Recogniser:
    """Learns from a bounded sample of the labelled rows outside the held-out fold."""
    return train(labelled_sample(df, id_col, text_col, lang_col))


def predict(df: DataFrame, recogniser: Recogniser, id_col: str = "doc_id", text_col: str = "text", passed: list[str] | None = None) -> DataFrame:
    """Per input row: id, lang_pred, score, cross_entropy, rejected, then the columns of `passed`."""
    shared = df.sparkSession.sparkContext.broadcast(recogniser)
    passed = passed or []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        r = shared.value
        codes = [codes_of(t) for t in b.column(1).to_pylist()]
        some = [i for i, c in enumerate(codes) if len(c)] if r.langs else []
        lang, score = np.full(len(codes), "und", object), np.zeros(len(codes))
        entropy, rejected = np.full(len(codes), np.nan), np.ones(len(codes), bool)
        if some:
            x = cross_entropies(r.models, [codes[i] for i in some])
            n = np.array([len(codes[i]) for i in some])
            best = x.argmin(1)
            least = x[np.arange(len(some)), best]
            lang[some] = np.array(r.langs, object)[best]
            score[some] = 1 / np.exp(-(x - least[:, None]) * np.minimum(n, 64)[:, None]).sum(1)
            entropy[some] = least
            rejected[some] = least > r.limits(n, best)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(lang, pa.string()), pa.array(score.round(9)), pa.array(entropy.round(9), from_pandas=True), pa.array(rejected), *(b.column(i) for i in range(2, b.num_columns))],
            names=[id_col, "lang_pred", "score", "cross_entropy", "rejected", *(f"in_{c}" for c in passed)],
        )

    schema = f"`{id_col}` {kinds[id_col]}, lang_pred string, score double, cross_entropy double, rejected boolean" + "".join(f", `in_{c}` {kinds[c]}" for c in passed)
    return map_batches(df.select(id_col, text_col, *passed), per_batch, schema)


def language_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, cross_entropy, rejected."""
    out = predict(df, fit_recogniser(df, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_recognised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, unchanged, that are not rejected."""
    out = predict(df, fit_recogniser(df, id_col, text_col, lang_col), id_col, text_col, passed=df.columns)
    return out.where(~F.col("rejected")).select(*(F.col(f"in_{c}").alias(c) for c in df.columns))
