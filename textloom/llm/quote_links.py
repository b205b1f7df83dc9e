"""Chat formatting by quotation linking.

A message's lines carry a quote level: how many `>` marks they start with. Runs of lines of
one level are passages; a line that ends in `wrote:` right before a quoted line is its
attribution. Passages and messages are normalised alike (lower case, runs of other characters
than letters and digits as one space). A passage answers the latest earlier message of the
conversation that holds it as a run of whole units, a unit being a sentence or what of it
stands on one line: any sentences, lines or paragraphs in a row, wrapped alike or not, however
short. Passages and the places where units begin are joined by hashes of the first words
there; where these agree, 128-bit hashes of the whole passage and of as much text from the
place settle the rest. The latest earlier message is found as of the quoting turn, by one ordered union
of quotes and sources. A message replies to the latest message its outermost linked quotes
answer, else to the turn before it. Conversations are then written without quotes, each
message after the one it replies to: ordered by that turn, then by its own.

Scale: parsing is one narrow pass of higher-order functions, linear in the lines; joins carry
hashes only, and just conversations that hold quotes reach them; a table without any quote skips them. A sentence said and quoted
over and over is one passage, so its links grow with its turns and not with their square.
Ranks in reply order and the as-of union are made in spans of SPAN turns and put together
by counts per span, so a conversation of any length is ordered as a whole and no task
holds it. It is written in parts of PART_TURNS consecutive messages of that order.

Defined results: null text is empty; a null role is written as `user`; quotes that match no
earlier message are dropped from the text and counted as unlinked; a turn without a link and
without a turn before it replies to nothing; rows without conversation or turn are left out;
repeated turns keep the least text; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import bound
from textloom.llm.common import sha256_hex, stored

PART_TURNS = 256
#: Turns that are ranked or searched at once.
SPAN = 4096
MARKS = "^[ \\t]*(>[ \\t]*)*"
#: Where a message's units part: at line ends and behind the marks that end sentences.
UNIT_ENDS = "\\r?\\n|(?<=[.!?…][\"')\\]»”’]{0,3})\\s+|(?<=[。！？])"
#: Units whose ends are summed up at once.
END_BLOCK = 128
#: Words that a key is made of; shorter passages are keyed whole.
KEY_WORDS = 4


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def units(text: Column) -> Column:
    """The normalised units of a text; joined by spaces they are the normalised text."""
    return F.filter(F.transform(F.split(text, UNIT_ENDS), normalised), lambda x: x != "")


def unit_ends(units: Column) -> Column:
    """Where each unit ends in the units joined by spaces.

    Sums run over blocks of END_BLOCK units and then inside each block, so a long array is not copied unit by unit."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, n: acc + n)
    append = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    numbers = lambda sizes: F.sequence(F.lit(0), F.call_function("div", F.size(sizes) - 1, F.lit(END_BLOCK)).cast("int"))

    def of(sizes: Column) -> Column:
        parts = F.transform(numbers(sizes), lambda k: F.slice(sizes, k * END_BLOCK + 1, END_BLOCK))
        return bound(parts, lambda p: bound(F.aggregate(F.transform(p, total), F.array(F.lit(0)), append), lambda before: inside(p, before)))

    def inside(parts: Column, before: Column) -> Column:
        ends = lambda part, k: F.slice(F.aggregate(part, F.array(F.get(before, k)), append), 2, END_BLOCK)
        return F.transform(F.flatten(F.transform(parts, ends)), lambda end: end - 1)

    return bound(F.transform(units, lambda u: F.length(u) + 1), lambda sizes: F.when(F.size(sizes) > 0, of(sizes)).otherwise(F.array().cast("array<int>")))


def first_words(plain: Column) -> Column:
    """What passages and places of a message are joined by."""
    return F.xxhash64(F.substring_index(plain, " ", KEY_WORDS))


def places(units: Column, ends: Column) -> Column:
    """Structs (at, key) of the places where units begin, once for each key that a passage from there can have."""
    def of(u: Column, i: Column) -> Column:
        runs = [F.array_join(F.slice(units, i + 1, r), " ") for r in range(1, KEY_WORDS + 1)]
        # a run of fewer words than a key has is keyed whole; KEY_WORDS units hold a full key if there is one
        keys = F.array(first_words(runs[-1]), *(F.when(F.size(F.split(x, " ")) < KEY_WORDS, F.xxhash64(x)) for x in runs[:-1]))
        at = F.get(ends, i) - F.length(u)
        return F.transform(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())), lambda k: F.struct(at.alias("at"), k.alias("key")))

    return F.flatten(F.transform(units, of))


def parsed_lines(text: Column) -> Column:
    """The lines as structs (level, body, told); told marks attributions."""
    level = lambda x: F.regexp_count(F.regexp_extract(x, MARKS, 0), F.lit(">"))

    def of(raw: Column, levels: Column) -> Column:
        return F.transform(
            raw,
            lambda x, i: F.struct(
                F.get(levels, i).alias("level"),
                F.when(F.get(levels, i) > 0, F.trim(F.regexp_replace(x, MARKS, ""))).otherwise(x).alias("body"),
                (F.rtrim(x).endswith("wrote:") & (F.coalesce(F.get(levels, i + 1), F.lit(0)) > F.get(levels, i))).alias("told"),
            ),
        )

    return bound(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda raw: bound(F.transform(raw, level), lambda levels: of(raw, levels)))


def passages_of(kept: Column) -> Column:
    """Structs (level, body) of the runs of quoted lines of one level."""

    def of(lines: Column) -> Column:
        begins = lambda x, i: (i == 0) | (F.get(lines, F.greatest(i - 1, F.lit(0)))["level"] != x["level"])
        starts = F.filter(F.transform(lines, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
        body = lambda i, end: F.array_join(F.transform(F.slice(lines, i + 1, F.coalesce(end, F.size(lines)) - i), lambda x: x["body"]), "\n")
        runs = bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(lines, i)["level"].alias("level"), F.when(F.get(lines, i)["level"] > 0, body(i, F.get(at, k + 1))).alias("body"))))
        return F.filter(runs, lambda x: x["level"] > 0)

    return bound(kept, of)


def parsed(messages: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, own (text without quotes), passages (level, body)."""
    distinct = (
        messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("user")).alias("role"))).alias("m"))
        .select("conv_id", "turn", "m.role", "m.text")
    )
    quoted = F.col("text").contains(">")
    kept = F.filter("lines", lambda x: ~x["told"])
    none = F.array().cast("array<struct<level:int,body:string>>")
    own = F.array_join(F.transform(F.filter(kept, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return distinct.withColumn("lines", F.when(quoted, parsed_lines(F.col("text")))).select(
        "conv_id",
        "turn",
        "role",
        F.when(quoted, F.regexp_replace(own, "^\\n+|\\n+$", "")).otherwise(F.col("text")).alias("own"),
        F.when(quoted, passages_of(kept)).otherwise(none).alias("passages"),
    )


def hashes(plain: Column) -> list[Column]:
    return [F.xxhash64(plain).alias("p1"), F.xxhash64(F.lit(1), plain).alias("p2")]


def latest_before(quotes: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, turn, source): of each quote's turn the latest source before it, or null.

    quotes: distinct (key, turn), sources: distinct (key, source). Within a span of turns the
    two are one ordered union; what comes from earlier spans is a maximum per span."""
    span = lambda t: F.floor(F.col(t) / SPAN).alias("span")
    asked = quotes.select(*key, span("turn"), F.col("turn").alias("t"), F.lit(None).cast("bigint").alias("source"))
    said = sources.select(*key, span("source"), F.col("source").alias("t"), "source")
    # a quote stands before what its own turn says
    order = Window.partitionBy(*key, "span").orderBy("t", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = asked.unionByName(said).withColumn("found", F.last("source", ignorenulls=True).over(order)).where("source IS NULL").drop("source")
    spans = asked.unionByName(said).groupBy(*key, "span").agg(F.max("source").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*key, "span", F.max("last").over(earlier).alias("carried"))
    return within.join(carried, [*key, "span"], "left").select(*key, F.col("t").alias("turn"), F.coalesce("found", "carried").alias("source"))


def linked_quotes(turns: DataFrame) -> DataFrame:
    """One row per quoted passage: conv_id, turn, n, level, source (the turn it quotes, or null)."""
    told = turns.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("n", "p")).select("conv_id", "turn", "n", "p.level", normalised(F.col("p.body")).alias("plain"))
    passages = told.select("conv_id", "turn", "n", "level", *hashes(F.col("plain")), F.length("plain").alias("size"), first_words(F.col("plain")).alias("key"))
    wanted = passages.where("size > 0")
    originals = (
        turns.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", F.col("turn").alias("source"), units(F.col("own")).alias("units"))
        .where(F.size("units") > 0)
        .select("conv_id", "source", "units", unit_ends(F.col("units")).alias("ends"))
    )
    begun = originals.select("conv_id", "source", F.explode(places(F.col("units"), F.col("ends"))).alias("p")).select("conv_id", "source", "p.at", "p.key")
    # places where a passage may stand, one row for each length that is asked for there
    asked = begun.join(wanted.select("conv_id", "key", "size").distinct(), ["conv_id", "key"]).groupBy("conv_id", "source").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    # only spans that end with a unit fetch their message
    last = originals.select("conv_id", "source", F.explode("ends").alias("end"))
    whole = originals.select("conv_id", "source", F.array_join("units", " ").alias("whole"))
    spans = asked.select("conv_id", "source", F.explode("spans").alias("x")).select("conv_id", "source", "x.at", "x.size", (F.col("x.at") + F.col("x.size")).alias("end")).join(last, ["conv_id", "source", "end"])
    spoken = spans.join(whole, ["conv_id", "source"]).select("conv_id", "source", *hashes(F.substring(F.col("whole"), F.col("at") + 1, F.col("size")))).distinct()
    key = ["conv_id", "p1", "p2"]
    found = latest_before(wanted.select(*key, "turn").distinct(), spoken.select(*key, F.col("source").cast("bigint").alias("source")), key).where("source IS NOT NULL")
    return passages.join(found, [*key, "turn"], "left").select("conv_id", "turn", "n", "level", "source")


def replies(messages: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, reply_to, n_quotes, n_linked, text without quotes."""
    turns = stored(parsed(messages), "turns")
    quoting = turns.where(F.size("passages") > 0).select("conv_id").distinct()
    if quoting.isEmpty():
        quotes = turns.limit(0).select("conv_id", "turn", F.lit(0).alias("n"), F.lit(0).alias("level"), F.col("turn").cast("bigint").alias("source"))
    else:
        quotes = linked_quotes(turns)
    # among the linked passages the outermost level decides, then the latest source
    answers = quotes.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("outer"), "source"))).alias("best"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    return (
        turns.join(answers, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", F.coalesce("best.source", "previous").alias("reply_to"), F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.col("own").alias("text"))
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Adds position, the row's place from 0 in the order (after, turn) of its conversation.

    Ranks are taken within spans; what lies before a span is a sum of counts."""
    spans = turns.withColumn("g", F.floor(F.col("after") / SPAN)).withColumn("s", F.floor(F.col("turn") / SPAN))
    inner, outer = ["conv_id", "g", "after", "s"], ["conv_id", "g"]
    counted = spans.groupBy(*inner).agg(F.count("*").alias("m"))
    before = lambda part, order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    nearer = counted.select(*inner, F.coalesce(F.sum("m").over(before(outer, ["after", "s"])), zero).alias("nearer"))
    further = counted.groupBy(*outer).agg(F.sum("m").alias("m")).select(*outer, F.coalesce(F.sum("m").over(before(["conv_id"], ["g"])), zero).alias("further"))
    own = F.row_number().over(Window.partitionBy(*inner).orderBy("turn")) - 1
    return spans.withColumn("own", own).join(nearer, inner).join(further, outer).withColumn("position", F.col("further") + F.col("nearer") + F.col("own")).drop("g", "s", "own", "nearer", "further")


def conversations(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation part: conv_id, part, n_turns, n_quotes, n_linked, reply_order, chat."""
    answered = replies(messages).withColumn("after", F.coalesce("reply_to", F.lit(-1)).cast("bigint"))
    placed = in_order(answered.select("conv_id", "turn", "after", "role", "text", "n_quotes", "n_linked"))
    return (
        placed.withColumn("part", F.floor(F.col("position") / part_turns).cast("bigint"))
        .groupBy("conv_id", "part")
        .agg(F.count("*").alias("n_turns"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.sort_array(F.collect_list(F.struct("position", "turn", "role", "text"))).alias("m"))
        .select(
            "conv_id", "part", "n_turns", "n_quotes", "n_linked",
            F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ",").alias("reply_order"),
            F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"])), "\n").alias("chat"),
        )
    )


def chat_digest(messages: DataFrame) -> DataFrame:
    """conversations() with the chat text as a digest."""
    return conversations(messages).select("conv_id", "part", "n_turns", "n_quotes", "n_linked", "reply_order", F.length("chat").cast("bigint").alias("n_chars"), sha256_hex(F.col("chat")).alias("chat_sha256"))
