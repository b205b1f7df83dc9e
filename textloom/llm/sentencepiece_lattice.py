"""SentencePiece encoding and decoding as a relational lattice.

A text is cut into units that no piece of the model can span (proved from the piece table:
runs of letters or of other characters, each with the spaces before it). Each distinct unit
is encoded once: its substrings of at most the longest piece's length are exploded and
equi-joined to the piece table, the edges found are grouped by unit, and a fold of Spark's
higher-order `aggregate` picks the path. For unigram models the fold is Viterbi. A BPE model
is not a best path but a sequence of merges, so there the fold goes once through the edges,
best first, and takes each that joins exactly two current symbols, over a bit set of the
symbols' borders. That is the sequence of merges unless a merge makes an edge possible that
has gone by; only pieces ranked no later than a part of theirs can do so (known from the
piece table), so after each merge just those are looked at, and a unit where it happens is
folded again merge by merge. Single characters without a piece become byte pieces.

Scale: texts are cut into units twice, in Arrow batches. Once to find the distinct ones by
partial counts; they stay where that shuffle put them for join, grouping and fold. Then for
the documents: units seen often (at most DICTIONARY of them, by a threshold on their counts)
are met by a broadcast and summed up in the batch, the rest leave it as (document, place,
unit) for one join.

Defined results: null and empty texts have no tokens; units of more than FOLDED characters
are merged by an exact heap; texts are encoded whole; rows of equal
id and text share results; other input columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from textloom.functions.text import bound
from textloom.llm.common import map_batches, ship, stored

SPACE = "▁"
#: A unit's borders must fit the bits of a 64-bit number.
FOLDED = 60
#: Bits of a piece id where an edge is one number; ranks get what 64 bits leave beside two places of 6 and a mark.
ID_BITS = 23
#: Set beside a unit's borders when its merges must be taken one by one.
AGAIN_BIT = 62
#: Units that a task groups edges for in memory; beyond, it sorts.
GROUPED = {"spark__sql__objectHashAggregate__sortBased__fallbackThreshold": "100000"}
#: Units that are broadcast back to documents, at most.
DICTIONARY = 250_000
#: Rows of the piece table that may be broadcast; a larger one is joined by a shuffle.
MAX_PIECES = 1_000_000
#: How texts are cut into units: at borders of letters and other characters, or at spaces only.
BY_CLASS, BY_SPACE = "class", "space"
#: Distinct units that a task counts before it passes them on.
COUNTED = 400_000
#: The digest of a unit in its place is (place % PLACES + 1) * hash % PRIME.
PLACES, PRIME = 65_521, (1 << 31) - 1


#: Code points below which a pattern knows the letters: small classes are looked up, large ones searched.
BELOW = (0x80, 0x250, 0x10000, 0x110000)
BEYOND = [re.compile(f"[^\\x00-{chr(b - 1)}]") for b in BELOW[1:-1]]


@lru_cache(len(BELOW))
def letter_class(below: int = BELOW[-1]) -> str:
    """Letters and marks among the code points below a number, as the inside of a character class."""
    runs = (list(run) for is_letter, run in groupby(range(below), lambda c: unicodedata.category(chr(c))[0] in "LM") if is_letter)
    return "".join(chr(r[0]) if len(r) == 1 else f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


@lru_cache(2 * len(BELOW))
def cutter(kind: str, below: int = BELOW[-1]) -> re.Pattern:
    """The pattern of a unit in a text of characters below a number."""
    if kind == BY_SPACE:
        return re.compile(" *[^ ]+| +")
    letters = letter_class(below)
    return re.compile(f" *[{letters}]+| *[^{letters} ]+| +")


def below_what(text: str) -> int:
    """The least of BELOW that all characters of a text are below."""
    if text.isascii():
        return BELOW[0]
    return next((b for b, beyond in zip(BELOW[1:], BEYOND) if not beyond.search(text)), BELOW[-1])


class Pieces(NamedTuple):
    """A model file's piece table: piece to (id, score), id to bytes, and how to use them."""

    ids: dict[str, tuple[int, float]]
    content: dict[int, bytes]
    bytes_from: int | None
    unknown: int
    unigram: bool
    dummy_prefix: bool
    longest: int
    units: str


@lru_cache(4)
def load(path: str) -> Pieces:
    """Reads a model; refuses those whose normalisation is more than identity."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation and escaped spaces are supported")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    ids = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    raw = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
    content = {i: piece.encode() for piece, (i, _) in ids.items()} | {i: bytes([b]) for i, b in raw.items()}
    first = min(raw, default=None)
    if raw and (len(raw) != 256 or any(raw[first + b] != b for b in range(256))):
        raise ValueError("byte pieces must be 256 consecutive ids")
    # proved per piece: none has letters beside other characters, or a space after one
    one_class = re.compile(f"{SPACE}*(?:[{letter_class()}]*|[^{letter_class()}{SPACE}]*)")
    led = re.compile(f"{SPACE}*[^{SPACE}]*")
    if not all(led.fullmatch(p) for p in ids):
        raise ValueError("pieces with spaces inside are not supported")
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
    units = BY_CLASS if all(one_class.fullmatch(p) for p in ids) else BY_SPACE
    return Pieces(ids, content, first, unknown, proto.trainer_spec.model_type == 1, spec.add_dummy_prefix, max(map(len, ids)), units)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, rank, score, late), pieces with plain spaces; rank orders merges, best first; late pieces may become possible after their rank."""
    by_score = sorted(pieces.ids.items(), key=lambda x: (-x[1][1], x[1][0]))
    ranks: dict[float, int] = {}
    rank = {piece: ranks.setdefault(score, len(ranks)) for piece, (_, score) in by_score}

    def late(piece: str) -> bool:
        # single characters are symbols from the start, whatever their rank
        of = lambda part: -1 if len(part) == 1 else rank.get(part)
        parts = ((of(piece[:k]), of(piece[k:])) for k in range(1, len(piece)))
        return any(x is not None and y is not None and rank[piece] <= max(x, y) for x, y in parts)

    rows = [(piece.replace(SPACE, " "), i, rank[piece], float(score), late(piece)) for piece, (i, score) in by_score]
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double, late boolean")


def _sized(df: DataFrame, pieces: Pieces) -> DataFrame:
    return F.broadcast(df) if len(pieces.content) <= MAX_PIECES else df


def units_of(text: str | None, pieces: Pieces) -> list[str]:
    """The units of a text in order, which spell it; the character that stands for spaces in pieces counts as one."""
    return cutter(pieces.units, below_what(text)).findall((" " * pieces.dummy_prefix + text).replace(SPACE, " ")) if text else []


def lattice(units: DataFrame, pieces: Pieces, passed: tuple[str, ...] = ()) -> DataFrame:
    """(unit, passed, edges): edges are structs (at, s, e, id, late, score, inner, ends), by rank, then start; at is their place.

    While they are grouped, edges are single numbers (rank, start, end, mark and id side by
    side); only unigram models, whose fold needs scores, carry those beside them."""
    spark = units.sparkSession
    if max(pieces.content, default=0) >= 1 << ID_BITS:
        raise ValueError(f"piece ids must be below {1 << ID_BITS}")
    # a unit too long to fold has the one edge of the empty string
    short = F.when(F.length("unit") <= FOLDED, F.col("unit")).otherwise(F.lit(""))
    n = F.length(short)
    # the empty piece at the start keeps units of unknown characters
    table = piece_table(spark, pieces).unionByName(spark.createDataFrame([("", -1, -1, 0.0, False)], "piece string, id int, rank int, score double, late boolean"))
    spans = units.select("unit", *passed, F.explode(F.sequence(F.lit(0), n)).alias("from")).select(
        "unit", *passed, "from", F.explode(F.when(F.col("from") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("from") + 1)))).alias("size")
    )
    found = spans.select("unit", *passed, (F.col("from") - 1).alias("s"), "size", F.substring(short, F.greatest("from", F.lit(1)), F.col("size")).alias("piece")).join(_sized(table, pieces), "piece")
    big = lambda c: F.col(c).cast("bigint")
    code = F.when(F.col("id") >= 0, (((big("rank") * 64 + big("s")) * 64 + big("s") + big("size")) * 2 + big("late")) * (1 << ID_BITS) + big("id"))
    # units that come out of one shuffle are still together here, so grouping needs no other
    item = F.struct(code.alias("code"), "score") if pieces.unigram else code
    grouped = found.groupBy("unit", *passed).agg(F.sort_array(F.collect_list(item)).alias("codes"))
    one = F.lit(1).cast("bigint")

    def edge(x: Column, at: Column) -> Column:
        c = x["code"] if pieces.unigram else x
        place = F.shiftright(c, ID_BITS + 1)
        e, s_ = place.bitwiseAND(63).cast("int"), F.shiftright(place, 6).bitwiseAND(63).cast("int")
        return F.struct(
            at.alias("at"),
            s_.alias("s"),
            e.alias("e"),
            c.bitwiseAND((1 << ID_BITS) - 1).cast("int").alias("id"),
            (F.shiftright(c, ID_BITS).bitwiseAND(1) == 1).alias("late"),
            (x["score"] if pieces.unigram else F.lit(0.0)).alias("score"),
            (F.call_function("shiftleft", one, e) - F.call_function("shiftleft", one, s_ + 1)).alias("inner"),
            F.call_function("shiftleft", one, s_).bitwiseOR(F.call_function("shiftleft", one, e)).alias("ends"),
        )

    codes = F.filter("codes", lambda x: x["code"].isNotNull()) if pieces.unigram else F.col("codes")
    return grouped.select("unit", *passed, F.transform(codes, edge).alias("edges"))


def _joins(b: Column, x: Column) -> Column:
    """Whether an edge joins exactly two symbols of those between the borders b."""
    return (b.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(b.bitwiseAND(x["inner"])) == 1)


def borders_merge_by_merge(edges: Column, n: Column) -> Column:
    """Bit set of the symbol borders left when no edge joins exactly two symbols any more, the best one taken at a time."""
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), n + 1) - 1
    step = lambda b, _: b.bitwiseAND(F.bitwise_not(F.coalesce(F.get(F.filter(edges, lambda x: _joins(b, x)), F.lit(0))["inner"], F.lit(0).cast("bigint"))))
    return F.when((n < 2) | (F.size(edges) == 0), every).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), every, step))


def borders_in_one_pass(edges: Column, n: Column) -> Column:
    """The same by one pass over the edges, with AGAIN_BIT set where an edge became possible after it had gone by."""
    again = F.lit(1 << AGAIN_BIT).cast("bigint")
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), n + 1) - 1

    def fold(lates: Column) -> Column:
        def step(b: Column, x: Column) -> Column:
            merged = b.bitwiseAND(F.bitwise_not(x["inner"]))
            missed = F.exists(lates, lambda y: (y["at"] < x["at"]) & _joins(merged, y))
            return F.when(_joins(b, x), F.when(missed, merged.bitwiseOR(again)).otherwise(merged)).otherwise(b)

        return F.aggregate(edges, every, step)

    return bound(F.filter(edges, lambda x: x["late"]), fold)


def merged_borders(edges: Column, n: Column) -> Column:
    """The borders after all merges; edges of one character must be left out."""
    again = lambda b: F.shiftright(b, AGAIN_BIT) != 0
    return bound(edges, lambda x: bound(borders_in_one_pass(x, n), lambda b: F.when(again(b), borders_merge_by_merge(x, n)).otherwise(b)))


def viterbi_borders(edges: Column, n: Column, unknown_score: float) -> Column:
    """Bit set of the borders of the best-scoring path; characters without a piece cost unknown_score.

    The fold runs over end positions; its state is, per position, the best score and borders.
    Ties go to the edge that starts first."""
    one = F.lit(1).cast("bigint")
    state = "array<struct<score:double,borders:bigint>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), one.alias("borders"))).cast(state)

    def step(acc: Column, end: Column) -> Column:
        arcs = F.transform(
            F.filter(edges, lambda x: x["e"] == end),
            lambda x: F.struct((F.get(acc, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("s"), F.get(acc, x["s"])["borders"].alias("borders")),
        )
        single = F.struct((F.get(acc, end - 1)["score"] + F.lit(unknown_score)).alias("score"), (1 - end).alias("s"), F.get(acc, end - 1)["borders"].alias("borders"))
        known = F.exists(edges, lambda x: (x["e"] == end) & (x["s"] == end - 1))
        best = F.array_max(F.when(known, arcs).otherwise(F.concat(arcs, F.array(single))))
        return F.concat(acc, F.array(F.struct(best["score"].alias("score"), best["borders"].bitwiseOR(F.call_function("shiftleft", one, end)).alias("borders"))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.get(acc, n)["borders"])


def ids_between(edges: Column, borders: Column, unit: Column, n: Column, pieces: Pieces) -> Column:
    """The piece ids of the symbols between the borders, bytes for characters without a piece."""

    def spelled(i: Column) -> Column:
        if pieces.bytes_from is None:
            return F.array(F.lit(pieces.unknown))
        hexed = F.hex(F.encode(F.replace(F.substring(unit, i + 1, F.lit(1)), F.lit(" "), F.lit(SPACE)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda j: F.conv(F.substring(hexed, j, F.lit(2)), 16, 10).cast("int") + pieces.bytes_from)

    def of(b: Column) -> Column:
        bit = lambda i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1).cast("bigint")) == 1

        def spell(whole: Column) -> Column:
            in_order = F.transform(F.sort_array(F.transform(whole, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))), lambda x: x["id"])
            bare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: bit(i) & bit(i + 1) & ~F.exists(whole, lambda x: x["s"] == i))
            known = F.transform(whole, lambda x: F.struct(x["s"].alias("s"), F.array(x["id"]).alias("ids")))
            unknown = F.transform(bare, lambda i: F.struct(i.alias("s"), spelled(i).alias("ids")))
            covered = F.aggregate(whole, F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
            return F.when(covered == n, in_order).otherwise(F.flatten(F.transform(F.sort_array(F.concat(known, unknown)), lambda x: x["ids"])))

        return bound(F.filter(edges, lambda x: (b.bitwiseAND(x["ends"]) == x["ends"]) & (b.bitwiseAND(x["inner"]) == 0)), spell)

    return bound(borders, of)


def heap_merge(unit: str, pieces: Pieces) -> list[int]:
    """The same merges for a unit of any length: a heap of candidate pairs over linked symbols."""
    ids = pieces.ids
    text, n = list(unit.replace(" ", SPACE)), len(unit)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (both := text[i] + text[j]) in ids:
            heapq.heappush(heap, (-ids[both][1], i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if not text[i] or (j := after[i]) >= n or text[i] + text[j] != both:
            continue
        text[i], text[j], after[i] = both, "", after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out: list[int] = []
    for symbol in filter(None, text):
        if symbol in ids:
            out.append(ids[symbol][0])
        elif pieces.bytes_from is None:
            out.append(pieces.unknown)
        else:
            out += [pieces.bytes_from + b for b in symbol.encode()]
    return out


def encode_units(units: DataFrame, model: str, passed: tuple[str, ...] = ()) -> DataFrame:
    """(unit, passed, ids) for a table of distinct units; ids are null for those too long to fold."""
    pieces = load(model)
    size = F.length("unit")
    unknown_score = min((score for _, score in pieces.ids.values()), default=0.0) - 10.0
    if pieces.unigram and not units.where(size > FOLDED).isEmpty():
        raise ValueError(f"unigram models take units of at most {FOLDED} characters")
    fits = size <= FOLDED
    n = F.when(fits, F.greatest(size, F.lit(1))).otherwise(F.lit(1))
    edges = lattice(units, pieces, passed)
    if pieces.unigram:
        folded = edges.select("unit", *passed, "edges", viterbi_borders(F.col("edges"), n, unknown_score).alias("b"))
    else:
        longer = F.filter("edges", lambda x: x["inner"] != 0)
        folded = edges.select("unit", *passed, "edges", merged_borders(longer, n).alias("b"))
    ids = F.when(fits & (size > 0), ids_between(F.col("edges"), F.col("b"), F.col("unit"), n, pieces))
    return folded.select("unit", *passed, ids.alias("ids"))


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """(unit, n, ids, exact): exact tells whether the ids' bytes spell the unit; units too long to fold are merged here.

    encoded: (unit, n, ids)."""

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(model)
        units = b.column(0).to_pylist()
        ids = [heap_merge(u, pieces) if i is None else i for u, i in zip(units, b.column(2).to_pylist(), strict=True)]
        spelt = [b"".join([pieces.content.get(i, b"") for i in x]) == u.replace(" ", SPACE).encode() for u, x in zip(units, ids, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(spelt)], names=["unit", "n", "ids", "exact"])

    return map_batches(encoded.select("unit", "n", "ids"), per_batch, "unit string, n bigint, ids array<int>, exact boolean")


def decode(ids: DataFrame, model: str, key: list[str], ids_col: str = "ids") -> DataFrame:
    """(key, text): ids joined to the piece table, their bytes put together in order; key must be unique."""
    pieces = load(model)
    spark = ids.sparkSession
    table = _sized(spark.createDataFrame([(i, c.hex()) for i, c in pieces.content.items()], "piece_id int, hexed string"), pieces)
    parts = ids.select(*key, F.posexplode_outer(ids_col).alias("pos", "piece_id")).join(table, "piece_id", "left")
    joined = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "hexed"))).alias("parts"))
    spelt = F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["hexed"]), "")), "UTF-8")
    return joined.select(*key, F.replace(spelt, F.lit(SPACE), F.lit(" ")).alias("text"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def occurrences(docs: DataFrame, model: str, id_col: str, text_col: str) -> DataFrame:
    """(id, h, pos, unit) of every unit of every document."""

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        units = [units_of(t, load(model)) for t in b.column(2).to_pylist()]
        sizes = [len(u) for u in units]
        at = pa.array(np.repeat(np.arange(len(units)), sizes))
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(places), pa.array([u for us in units for u in us], pa.string())], names=["id", "h", "pos", "unit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(_identified(docs, id_col, text_col), per_batch, f"id {kind}, h bigint, pos int, unit string")


def unit_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(unit, n) of the distinct units; each task passes partial counts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        passed = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["unit", "m"])
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(units_of(t, load(model)))
                if len(held) > COUNTED:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    ship(docs.sparkSession)
    return docs.select(text_col).mapInArrow(run, "unit string, m bigint").groupBy("unit").agg(F.sum("m").alias("n"))


def unit_table(docs: DataFrame, model: str, text_col: str = "text") -> tuple[DataFrame, Column]:
    """(unit, n, ids, exact) of the distinct units, written, and which rows are seen often: at most DICTIONARY."""
    # one shuffle brings equal units together; lattice, grouping, fold and decoding follow in its tasks
    encoded = encode_units(unit_counts(docs, model, text_col), model, ("n",))
    table = stored(decoded(encoded, model), "encoded", **GROUPED)
    sizes = {r["k"]: r["m"] for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}  # at most 64 rows
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= DICTIONARY:
        least -= 1
        held += sizes.get(least, 0)
    return table, F.floor(F.log2("n")) >= least


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, ids): one row per distinct document that has tokens, its ids in order."""
    table, often = unit_table(docs, model, text_col)
    known = occurrences(docs, model, id_col, text_col).join(F.broadcast(table.where(often).select("unit", "ids")), "unit", "left")
    rare = known.where("ids IS NULL").select("id", "h", "pos", "unit").join(table.where(~often).select("unit", "ids"), "unit")
    return (
        known.where("ids IS NOT NULL")
        .unionByName(rare)
        .groupBy("id", "h")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "ids"))).alias("parts"))
        .select("id", "h", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    )


class Missing(dict):
    """Unit to its row in the dictionary; -1 for others."""

    def __missing__(self, unit: str) -> int:
        return -1


def met_units(docs: DataFrame, model: str, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document of sums over the units in the dictionary, and a row per other unit of it.

    (id, h, rare, place, units, tokens, digests, exact); rare is null in the former. dictionary:
    (unit, size, hash, exact), at most DICTIONARY rows."""
    spark = docs.sparkSession
    held = dictionary.toArrow()  # bounded by DICTIONARY
    numbers = [held.column(c).to_numpy().astype(np.int64) for c in ("size", "hash")] + [held.column("exact").to_numpy(zero_copy_only=False).astype(bool)]
    shared = spark.sparkContext.broadcast((Missing(zip(held.column("unit").to_pylist(), range(len(held)), strict=True)), *numbers))
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        row, size, hashed, exact = shared.value
        pieces, get = load(model), row.__getitem__
        sums: list[tuple[int, int, int, bool]] = []
        owner: list[int] = []
        rare: list[str] = []
        places: list[int] = []
        for i, text in enumerate(b.column(2).to_pylist()):
            units = units_of(text, pieces)
            at = np.fromiter(map(get, units), np.int64, len(units))
            met = np.flatnonzero(at >= 0)
            known = at[met]
            sums.append((len(met), int(size[known].sum()), int(((met % PLACES + 1) * hashed[known] % PRIME).sum()), bool(exact[known].all())))
            for k in np.flatnonzero(at < 0).tolist():
                owner.append(i)
                rare.append(units[k])
                places.append(k)
        n, m = len(sums), len(rare)
        at = pa.array([*range(n), *owner], pa.int64())
        whole = lambda k, rest, kind: pa.array([s[k] for s in sums] + [rest] * m, kind)
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array([None] * n + rare, pa.string()), pa.array([None] * n + places, pa.int32()), whole(0, 1, pa.int64()), whole(1, 0, pa.int64()), whole(2, 0, pa.int64()), whole(3, True, pa.bool_())],
            names=["id", "h", "rare", "place", "units", "tokens", "digests", "all_exact"],
        )

    return map_batches(_identified(docs, id_col, text_col), per_batch, f"id {kind}, h bigint, rare string, place int, units bigint, tokens bigint, digests bigint, all_exact boolean")


def encoding_summary(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_units, n_tokens, ids_hash, round_trip).

    ids_hash sums digests of (unit position, hash of its ids) over all units, so it changes with
    any id or their order; round_trip says that the ids of every unit decode to it."""
    table, often = unit_table(docs, model, text_col)
    facts = lambda rows: rows.select("unit", F.size("ids").alias("size"), F.pmod(F.xxhash64("ids"), F.lit(PRIME)).alias("hash"), "exact")
    met = (
        met_units(docs, model, facts(table.where(often)), id_col, text_col)
        .withColumn("is_rare", F.col("rare").isNotNull())
        # sums are dealt out by their text and meet nothing
        .withColumn("rare", F.coalesce("rare", F.col("h").cast("string")))
    )
    others = facts(table.where(~often)).withColumnRenamed("unit", "rare").withColumn("is_rare", F.lit(True))
    digest = (F.col("place") % PLACES + 1).cast("bigint") * F.col("hash") % PRIME
    # repeated rows come in as many copies of every unit
    return (
        met.join(others, ["rare", "is_rare"], "left")
        .groupBy("id", "h")
        .agg(
            F.count_if(~F.col("is_rare")).alias("copies"),
            F.sum("units").alias("units"),
            F.sum(F.when(F.col("is_rare"), F.col("size")).otherwise(F.col("tokens"))).alias("tokens"),
            F.sum(F.when(F.col("is_rare"), digest).otherwise(F.col("digests"))).alias("digests"),
            F.min(F.when(F.col("is_rare"), F.col("exact")).otherwise(F.col("all_exact"))).alias("round_trip"),
        )
        .select("id", *(F.expr(f"{c} div copies").alias(a) for c, a in (("units", "n_units"), ("tokens", "n_tokens"), ("digests", "ids_hash"))), "round_trip", F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy"))
        .select(F.col("id").alias(id_col), "n_units", "n_tokens", "ids_hash", "round_trip")
    )
