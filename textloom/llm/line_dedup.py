"""Line dedup by a segment-partition edit join.

A line is dropped when an earlier line (by document id, then line number) is equal to it or
near it. Near are: two lines of at least `near_chars` characters within `max_edits` edits; two
of at least `short_chars` within one; and, of any length, two lines within a budget of edited
(changed, dropped or added) words, which is one in every `words_an_edit` of the longer line,
from words_an_edit squared on its square root. Earlier lines count whether or not they are
dropped themselves, so the rule needs no closure.

Near lines are found among distinct lines only, characters and words by the same join. Lines
fall into classes by length. A class has a budget k, which no pair whose shorter line is in
it exceeds, and k + 1 segments of one size: the first half of them at fixed places from the
line's start, the rest at fixed places from its end. Of an alignment within the budget, let
segment i be the first with at most i edits in and before it: it has none, i lie before it
and at most k - i after. So the other line holds its content, moved by at most i places from
the start or k - i from the end. A line therefore indexes its k + 1 segments under its own
class and under the one that a shorter partner may be in, and probes, in its own class, the
(k + 1) * (k + 1) / 2 substrings that are left possible: as the budget is a square root at
most, that grows in proportion to the line.

Candidates are verified by Spark's banded, threshold-bounded edit distance; for words over
strings in which each word of the pair is one character. Lines are compared with the
earliest line of each key first; only what that does not settle is paired with the other
lines of its keys. In keys of more than CROWD rows it is paired by what sets it apart from that
earliest line, the head: words it has beyond the head's (p) and words it lacks (q), repeated
ones counted. Lines within k word edits differ by at most k words either way, so two of them
share at least max(p + q', p' + q) - k of these, and meet in the first ones by a common order; only
pairs for which that is not positive, which are nearly the head's own words, are paired as they
are. So a large group of near copies costs about its size, not its square.

Scale: equal lines meet only as (hash, first place) partial aggregates, so a line that a
third of all documents share is one row; keys are shuffled as two numbers in SLICES passes,
to bound disk; keys that one line alone has end there, by a count; texts of distinct lines
are written once and fetched again only for candidates. The verdicts on the most frequent
lines (at most FREQUENT of them) are broadcast, so no task gets all places of a line.

Defined results: null and empty texts have no lines to drop; blank lines stay; lines are
compared whole, of any length, by words up to MAX_CODES distinct ones in a pair; rows of equal id and text count as one document and get the
same result; a null id sorts before all others; other input columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textloom.functions.text import bound
from textloom.llm.common import stored

MAX_EDITS = 2
NEAR_CHARS = 40
#: From this length on a line may differ by one edit.
SHORT_CHARS = 20
#: One edited word is allowed for every so many words of the longer line.
WORDS_AN_EDIT = 10
#: Passes in which keys are shuffled, each with the segments of some numbers.
SLICES = 2
#: Lines whose verdicts are broadcast, at most: those with at least this share of all places.
FREQUENT = 10_000
#: Distinct words that a pair of lines may have to be compared by words: as many as there are characters beyond 0x10000.
MAX_CODES = 1_000_000
#: Characters whose counts two near lines must nearly share; any would do, frequent ones reject most.
COUNTED = ("e", "n", "t", "a", "i", "o", "r")
#: Buckets of word hashes whose counts two lines near by words must nearly share, and bits of a count.
BUCKETS, COUNT_BITS = 60, 4
#: Rows of a key up to which its lines are paired as they are.
CROWD = 64
#: What a key row is to its line, as bits: one of its segments, a probe, or both.
SEGMENT, PROBE = 1, 2


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines: (id, h, no, line, l1, l2); h hashes the text, (l1, l2) the line."""
    return (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
        .where(F.trim("line") != "")
        .withColumn("l1", F.xxhash64("line"))
        .withColumn("l2", F.xxhash64(F.lit(1), "line"))
    )


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def word_budget(n: Column, words_an_edit: int = WORDS_AN_EDIT) -> Column:
    """Edited words that a pair may have whose longer line has n words."""
    return F.least(_div(n, words_an_edit), F.floor(F.sqrt(n)).cast("int"))


def _width(n: Column) -> Column:
    """How many lengths the class of length n holds: an eighth to a quarter of n, or half of it below 20."""
    octave = F.length(F.bin(_div(n, 10))) - 1
    return F.when(n < 10, 1).otherwise(F.call_function("shiftleft", F.lit(5), F.greatest(octave - 1, F.lit(0))))


def _class(n: Column, own: Column, budget: Callable[[Column], Column]) -> Column:
    """The class of length n as struct: low (its least length), k (the budget by its greatest length), own."""
    return bound(n, lambda x: bound(_width(x), lambda w: F.struct((x - x % w).alias("low"), budget(x - x % w + w - 1).alias("k"), own.alias("own"))))


def _key_rows(lines: DataFrame, kind: int, size: str, classes: Column, content: str, cut, part: int) -> DataFrame:
    """(key, who) of the segments and probes with numbers of this part; who is the line's number and what the row is to it.

    cut(start, n) takes n units from the content column."""
    i, k, own = F.col("i"), F.col("c.k"), F.col("c.own")
    numbers = F.when(k >= part, F.sequence(F.lit(part), k, F.lit(SLICES)))
    reach = F.when(own, F.least(i, k - i)).otherwise(0)
    each = _div(F.col("low"), 1)
    segment = F.call_function("div", F.col("low"), F.col("k") + 1).cast("int")
    from_start, from_end = F.col("i") * segment, F.col(size) - (F.col("k") - F.col("i") + 1) * segment
    role = F.when(~F.col("own"), SEGMENT).when(F.col("shift") == 0, SEGMENT + PROBE).otherwise(PROBE)
    return (
        lines.select("lid", size, content, F.explode(classes).alias("c"))
        .where(F.col("c.k") > 0)
        .select("lid", size, content, "c", F.explode(numbers).alias("i"))
        .select("lid", size, content, F.col("c.low").alias("low"), k.alias("k"), own.alias("own"), "i", F.explode(F.sequence(-reach, reach)).alias("shift"))
        .select("lid", size, content, each.alias("low"), "i", segment.alias("n"), (F.when(F.col("i") <= _div(F.col("k"), 2), from_start).otherwise(from_end) + F.col("shift")).alias("start"), role.alias("role"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col(size)))
        .select(F.xxhash64(F.lit(kind), "low", "i", cut(F.col("start"), F.col("n"))).alias("key"), (F.col("lid") * 4 + F.col("role")).alias("who"))
    )


def _classes(lengths: Column, budget: Callable[[Column], Column]) -> Column:
    """The classes of falling lengths, each once; the first is the line's own."""
    each = F.transform(lengths, lambda n, i: _class(n, i == 0, budget))
    return bound(each, lambda c: F.filter(c, lambda x, i: (i == 0) | (x["low"] != F.get(c, F.greatest(i - 1, F.lit(0)))["low"])))


def word_classes(n: Column, words_an_edit: int = WORDS_AN_EDIT) -> Column:
    """The classes that a line of n words has keys in, its own first; none if it is too short."""
    # a longer line of n words within the budget of a shorter one of m: n - n / words_an_edit <= m
    budget = lambda m: word_budget(F.call_function("div", m * words_an_edit, F.lit(words_an_edit - 1)).cast("int") + 1, words_an_edit)
    return F.when(n >= words_an_edit - 1, _classes(F.array(n, n - word_budget(n, words_an_edit)), budget))


def char_classes(n: Column, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS, short_chars: int = SHORT_CHARS) -> Column:
    """The classes that a line of n characters has keys in, its own first; none if it is too short."""
    budget = lambda m: F.when(m >= near_chars, max_edits).when(m >= short_chars, 1).otherwise(0)
    shorter = F.transform(F.sequence(F.lit(0), F.lit(max_edits)), lambda j: F.greatest(n - j, F.lit(0)))
    return F.when(n >= min(near_chars, short_chars), _classes(shorter, budget))


def _by_words(lines: DataFrame, part: int) -> DataFrame:
    some = lines.where("word_classes IS NOT NULL").select("lid", "w", _words(F.col("line")).alias("words"), "word_classes")
    return _key_rows(some, 1, "w", F.col("word_classes"), "words", lambda start, n: F.slice("words", start + 1, n), part)


def _by_chars(lines: DataFrame, part: int) -> DataFrame:
    some = lines.where("char_classes IS NOT NULL").select("lid", "len", "line", "char_classes")
    return _key_rows(some, 0, "len", F.col("char_classes"), "line", lambda start, n: F.substring(F.col("line"), start + 1, n), part)


def few_words(max_edits: int, words_an_edit: int) -> int:
    """Lines of at least so many words that differ by max_edits characters are within the budget of words.

    A changed character costs two edited words at most; the partner may have max_edits words fewer."""
    n = words_an_edit
    while min(n // words_an_edit, isqrt(n)) < 2 * max_edits:
        n += 1
    return n + max_edits


def _coded(a: Column, b: Column) -> Column:
    """The arrays as two strings in which each distinct word of both is one character; null beyond MAX_CODES of them.

    One sort of the words with their places brings equal ones together; a run's number is its word's code."""
    placed = lambda x, side: F.transform(x, lambda w, i: F.struct(w.alias("w"), F.lit(side).alias("side"), i.alias("i")))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["w"] != F.get(s, F.greatest(i - 1, F.lit(0)))["w"]), i)), lambda i: i.isNotNull())

    def numbered(s: Column, starts: Column) -> Column:
        run = lambda i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - i), lambda x: F.struct(x["side"].alias("side"), x["i"].alias("i"), k.alias("code")))
        return F.when(F.size(starts) <= MAX_CODES, F.flatten(F.transform(starts, run)))

    def text(codes: Column, side: int) -> Column:
        own = F.array_sort(F.filter(codes, lambda x: x["side"] == side))
        return F.decode(F.unhex(F.array_join(F.transform(own, lambda x: F.lpad(F.hex(x["code"] + 0x10000), 8, "0")), "")), "UTF-32")

    codes = bound(F.array_sort(F.concat(placed(a, 0), placed(b, 1))), lambda s: bound(begins(s), lambda starts: numbered(s, starts)))
    return bound(codes, lambda c: F.struct(text(c, 0).alias("a"), text(c, 1).alias("b")))


def _within_words(a: Column, b: Column, words_an_edit: int) -> Column:
    """Whether the word arrays lie within their budget of word edits, each word of the two as one character."""
    budget = word_budget(F.greatest(F.size(a), F.size(b)), words_an_edit)
    distance = bound(_coded(a, b), lambda c: F.call_function("levenshtein", c["a"], c["b"], budget))
    return (budget > 0) & (F.abs(F.size(a) - F.size(b)) <= budget) & (F.size(F.array_except(a, b)) <= budget) & (F.size(F.array_except(b, a)) <= budget) & F.coalesce(distance >= 0, F.lit(False))


def bucket_counts(words: Column) -> Column:
    """Four numbers with the counts of the words in BUCKETS buckets by hash; counts end at what COUNT_BITS hold."""
    each, most = BUCKETS // 4, (1 << COUNT_BITS) - 1

    def add(acc: Column, x: Column) -> Column:
        place = x % each * COUNT_BITS
        full = F.call_function("shiftright", acc, place).bitwiseAND(most) == most
        return F.when(full, acc).otherwise(acc + F.call_function("shiftleft", F.lit(1).cast("bigint"), place))

    def of(hashes: Column) -> Column:
        part = lambda k: F.filter(hashes, lambda x: _div(x, each) == k)
        return F.array(*(F.aggregate(part(k), F.lit(0).cast("bigint"), add) for k in range(4)))

    return bound(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), of)


def word_tokens(line: Column) -> Column:
    """A hash for each word of a line and its number among equal words: the bag of words as a set."""
    ordered = F.array_sort(F.transform(_words(line), lambda w: F.xxhash64(w)))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())

    def numbered(s: Column, starts: Column) -> Column:
        run = lambda i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - i), lambda x, j: F.xxhash64(x, j))
        return F.flatten(F.transform(starts, run))

    return bound(ordered, lambda s: bound(begins(s), lambda starts: numbered(s, starts)))


def one_head_each(members: DataFrame) -> DataFrame:
    """(head, lid), each once, from (head as struct of by and lid, lid): groups whose heads stand in an earlier head's group become one.

    Near copies have a head for every edited segment; any line may be what the lines of a group are set apart from."""
    members = stored(members, "line_groups")
    heads = members.join(members.select(F.col("head.lid").alias("lid")).distinct(), "lid", "left_semi").groupBy("lid").agg(F.min("head").alias("to"))
    up = stored(heads, "line_group_heads")
    further = up.select(F.col("lid").alias("at"), F.col("to").alias("over"))
    reached = up.join(further, F.col("to.lid") == F.col("at")).select(F.col("lid").alias("old"), F.col("over.lid").alias("shared_head"))
    return members.join(reached, F.col("head.lid") == F.col("old")).select(F.col("shared_head").alias("head"), "lid").distinct()


def crowd_pairs(members: DataFrame, facts: DataFrame, max_edits: int, words_an_edit: int) -> DataFrame:
    """(lid, e_lid) of pairs that may be near in large groups, each once, the first being open and not earlier than the other.

    members: (head, lid, open), each once; facts: as in later_lines()."""
    tokens = stored(facts.join(members.select("lid").union(members.select("head")).distinct(), "lid", "left_semi").select("lid", word_tokens(F.col("line")).alias("t")), "line_tokens")
    known = ("by", "w", "len")
    apart = stored(
        members.join(tokens, "lid")
        .join(tokens.select(F.col("lid").alias("head"), F.col("t").alias("ht")), "head")
        .select("head", "lid", "open", F.array_except("t", "ht").alias("plus"), F.array_except("ht", "t").alias("minus"))
        .join(facts.select("lid", *known), "lid")
        .withColumns({"p": F.size("plus"), "q": F.size("minus")}),
        "line_apart",
    )
    # an edited character changes, joins or parts words: two at most on either side
    k_chars = 2 * max_edits
    own = word_budget(F.col("w"), words_an_edit)
    most = word_budget(_div(F.col("w") * words_an_edit, words_an_edit - 1) + 1, words_an_edit)
    k = word_budget(F.greatest("w", "e_w"), words_an_edit)
    need = lambda k: F.greatest(F.col("p") + F.col("e_q"), F.col("e_p") + F.col("q")) - k
    later = (F.col("lid") != F.col("e_lid")) & (F.col("e_by") <= F.col("by"))
    facing = lambda side, on, *more: side.select(*on, *(F.col(c).alias(f"e_{c}") for c in ("lid", "p", "q", *known, *more)))

    # one order for all lines of a head: words beyond the head's first, since fewer lines share one
    longest = F.greatest(most, F.lit(k_chars))
    ordered = F.concat(F.array_sort("plus"), F.array_sort(F.transform("minus", lambda x: F.bitwise_not(x))))
    first = F.slice(ordered, 1, F.least(2 * longest, F.least("p", "q") + longest) + 1)
    prefixes = stored(apart.select(*(c for c in apart.columns if c not in ("plus", "minus")), F.posexplode(first).alias("i", "token")), "line_prefixes")
    by_chars, by_words = F.abs(F.col("len") - F.col("e_len")) <= max_edits, F.abs(F.col("w") - F.col("e_w")) <= k
    within = lambda k: (need(k) >= 1) & (F.col("i") <= F.col("p") + F.col("q") - need(k)) & (F.col("e_i") <= F.col("e_p") + F.col("e_q") - need(k))
    met = prefixes.where("open").join(facing(prefixes, ("head", "token"), "i"), ["head", "token"]).where(later & ((by_words & within(k)) | (by_chars & within(F.lit(k_chars)))))

    # pairs that need share nothing, by the budget of their longer line: that of the open one, or a larger one of the other
    close = apart.select("head", "lid", "open", "p", "q", *known, own.alias("own"), F.explode(F.sequence(own, F.greatest(own, most))).alias("k")).where(F.greatest("p", "q") <= F.greatest(F.col("k"), F.lit(k_chars)))
    alike = later & ((by_words & (need(k) <= 0)) | (by_chars & (need(F.lit(k_chars)) <= 0)))
    longer_own = close.where("open AND k = own").join(facing(close, ("head", "k")), ["head", "k"]).where(alike)
    longer_other = close.where("open AND k > own").join(facing(close.where("k = own"), ("head", "k")), ["head", "k"]).where(alike)
    both = [x.select("lid", "e_lid") for x in (met, longer_own, longer_other)]
    return both[0].unionByName(both[1]).unionByName(both[2]).distinct()


def later_lines(lines: DataFrame, max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS, short_chars: int = SHORT_CHARS, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """(lid) of the lines that are near a line with an earlier first place.

    lines: (lid, first, by, line, len, w, counts, word_classes, char_classes), written; by is a
    number that never orders two lines against their first places."""
    if words_an_edit < 10:
        raise ValueError("more than one edited word in ten does not leave the classes of a line at two")
    parts = []
    for part in range(SLICES):
        # two columns, both used by either reader, so that the shuffle is made once for both
        rows = _by_words(lines, part).unionByName(_by_chars(lines, part)).repartition("key")
        who = F.shiftright("who", 2)
        held = rows.groupBy("key").agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least < most").select("key")
        # an inner join: a semi-join would be moved into the union, and either side shuffled for itself
        parts.append(stored(rows.join(held.hint("shuffle_hash"), "key"), "line_keys"))
    shared = parts[0]
    for p in parts[1:]:
        shared = shared.unionByName(p)
    # a line that repeats itself has a key at several places
    keyed = shared.groupBy("key", F.shiftright("who", 2).alias("lid")).agg(F.bit_or(F.col("who").bitwiseAND(3)).alias("role"))
    facts = stored(
        lines.join(keyed.select("lid").distinct(), "lid", "left_semi")
        .withColumn("b", bucket_counts(_words(F.col("line"))))
        .select("lid", "first", "by", "w", "len", "counts", *(F.get("b", F.lit(k)).alias(f"b{k}") for k in range(4)), "line"),
        "line_facts",
    )
    known = ("lid", "by", "w", "len", "counts", "b0", "b1", "b2", "b3")
    placed = stored(keyed.join(facts.select(*known), "lid"), "line_places")
    # as text: a column a term would take the driver longer than the join
    part_of = lambda c, k, bits: f"(shiftright({c}, {bits * k}) & {(1 << bits) - 1})"
    gap = lambda c, n, bits: " + ".join(f"abs({part_of(c, k, bits)} - {part_of(f'e_{c}', k, bits)})" for k in range(n))
    by_chars = (F.abs(F.col("len") - F.col("e_len")) <= max_edits) & (F.expr(gap("counts", len(COUNTED), 8)) <= 2 * max_edits)
    budget = word_budget(F.greatest("w", "e_w"), words_an_edit)
    # a changed word changes two counts by one; most pairs end at the first of the four
    first_gap, all_gaps = F.expr(gap("b0", BUCKETS // 4, COUNT_BITS)), F.expr(" + ".join(gap(f"b{k}", BUCKETS // 4, COUNT_BITS) for k in range(4)))
    by_words = (F.abs(F.col("w") - F.col("e_w")) <= budget) & (first_gap <= 2 * budget) & (all_gaps <= 2 * budget)
    fits = (F.col("lid") != F.col("e_lid")) & (by_chars | by_words)

    def early(side: DataFrame) -> DataFrame:
        return side.select("key", *(F.col(c).alias(f"e_{c}") for c in known))

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """The later lines of the candidates that are near."""
        found = stored(pairs.select(F.least("lid", "e_lid").alias("a"), F.greatest("lid", "e_lid").alias("b")).distinct(), name)
        of = lambda x: facts.select(F.col("lid").alias(x), F.col("first").alias(f"first_{x}"), F.col("line").alias(f"line_{x}"))
        least = F.least(F.length("line_a"), F.length("line_b"))
        edits = F.levenshtein("line_a", "line_b", max_edits)
        alike = (edits >= 0) & (edits <= F.when(least >= near_chars, max_edits).when(least >= short_chars, 1).otherwise(0))
        alike = alike | _within_words(_words(F.col("line_a")), _words(F.col("line_b")), words_an_edit)
        late = F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b"))
        return stored(found.join(of("a"), "a").join(of("b"), "b").where(alike).select(late.alias("lid")).distinct(), name)

    segments, probes = (placed.where(F.col("role").bitwiseAND(bit) != 0) for bit in (SEGMENT, PROBE))
    is_segment = F.col("role").bitwiseAND(SEGMENT) != 0
    heads = placed.groupBy("key").agg(F.min(F.when(is_segment, F.struct("by", *(c for c in known if c != "by")))).alias("head"), F.count_if(is_segment).alias("segments"), F.count("*").alias("rows")).where("segments > 0")
    first = heads.select("key", *(F.col(f"head.{c}").alias(f"e_{c}") for c in known))
    settled = near(probes.join(first, "key").where(fits), "line_heads")
    # what is left: pairs of which neither is the head of their key, so keys of two segments at least
    crowded = stored(heads.where("segments > 1").select("key", F.struct("head.by", "head.lid").alias("head"), "rows"), "line_crowded")
    open_ = lambda side: side.join(settled, "lid", "left_anti")
    few, many = crowded.where(F.col("rows") <= CROWD).select("key"), crowded.where(F.col("rows") > CROWD).select("key", "head")
    some = lambda side: side.join(few, "key", "left_semi")
    earlier = F.col("e_by") <= F.col("by")
    rest = some(open_(probes)).join(early(some(segments)), "key").where(earlier & fits)
    # the other way round the open line is the segment
    turned = some(open_(segments)).join(early(some(probes)), "key").where(earlier & fits)
    pairs = rest.unionByName(turned).select("lid", "e_lid")
    if not many.isEmpty():
        members = stored(one_head_each(placed.select("key", "lid").join(many, "key").select("head", "lid").distinct()), "line_members")
        told = members.join(settled.withColumn("settled", F.lit(True)), "lid", "left").select("head", "lid", F.col("settled").isNull().alias("open"))
        crowd = crowd_pairs(stored(told, "line_members"), facts, max_edits, words_an_edit)
        counted = facts.select(*known)
        pairs = pairs.unionByName(crowd.join(counted, "lid").join(counted.select(*(F.col(c).alias(f"e_{c}") for c in known)), "e_lid").where(fits).select("lid", "e_lid"))
    return settled.unionByName(near(pairs, "line_rest")).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS, short_chars: int = SHORT_CHARS, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """One row per document that loses lines: (id, h, dropped), dropped being sorted line numbers from 0."""
    occurring = _lines(docs, id_col, text_col)
    place = F.struct("id", "h", "no")
    compared = min(near_chars, short_chars, 2 * words_an_edit - 3)
    counts = sum((F.shiftleft(F.least(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit(""))), F.lit(127)).cast("bigint"), 8 * k) for k, c in enumerate(COUNTED)), F.lit(0).cast("bigint"))
    by = F.coalesce(F.col("first.id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")) if isinstance(docs.schema[id_col].dataType, IntegralType) else F.lit(0).cast("bigint")
    n, w = F.length("line"), F.size(_words(F.col("line")))
    found = (
        occurring.groupBy("l1", "l2")
        .agg(F.min(place).alias("first"), F.count("*").alias("places"), F.max(F.when(F.length("line") >= compared, F.col("line"))).alias("line"))
        .select(F.monotonically_increasing_id().alias("lid"), "l1", "l2", "first", by.alias("by"), "places", "line", n.alias("len"), w.alias("w"), F.when(F.col("line").isNotNull(), counts).alias("counts"))
    )
    kinds = {
        "word_classes": word_classes(F.col("w"), words_an_edit),
        "char_classes": F.when(F.col("w") < few_words(max_edits, words_an_edit), char_classes(F.col("len"), max_edits, near_chars, short_chars)),
    }
    distinct = stored(found.withColumns(kinds), "lines")
    later = later_lines(distinct.where(F.col("line").isNotNull()), max_edits, near_chars, short_chars, words_an_edit).withColumn("near", F.lit(True))
    verdicts = distinct.select("lid", "l1", "l2", "first", "places").join(later, "lid", "left").select("l1", "l2", "first", "near", "places")
    least = F.ceil(distinct.agg(F.sum("places").alias("n")).select("n").scalar() / FREQUENT)
    often = F.col("places") > least
    known = verdicts.where(often).select(F.col("l1").alias("o1"), F.col("l2").alias("o2"), F.col("first").alias("o_first"), F.col("near").alias("o_near"))
    told = occurring.select("id", "h", "no", "l1", "l2").join(F.broadcast(known), (F.col("l1") == F.col("o1")) & (F.col("l2") == F.col("o2")), "left")
    # places of frequent lines know their verdict; keys that no line has deal them out evenly
    dealt = told.withColumn("l1", F.when(F.col("o1").isNull(), F.col("l1")).otherwise(F.xxhash64("id", "h", "no")))
    others = verdicts.where(~often).select("l1", "l2", "first", "near")
    return (
        dealt.join(others, ["l1", "l2"], "left")
        .select("id", "h", "no", F.coalesce("o_first", "first").alias("first"), F.coalesce("o_near", "near").alias("near"))
        .where(F.col("near").isNotNull() | ~place.eqNullSafe(F.col("first")))
        .groupBy("id", "h")
        .agg(F.array_sort(F.collect_set("no")).alias("dropped"))
    )


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS, short_chars: int = SHORT_CHARS, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """One row per document: (id, n_lines, n_dropped, dropped); n_lines counts non-blank lines."""
    lost = dropped_lines(docs, id_col, text_col, max_edits, near_chars, short_chars, words_an_edit).select(F.col("id").alias("lost_id"), F.col("h").alias("lost_h"), "dropped")
    parts = F.split(F.coalesce(text_col, F.lit("")), "\n")
    # lines of spaces only are blank: what is left of the text when they go is counted
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("bigint").alias("n_lines"))
    return base.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("h") == F.col("lost_h")), "left").select(
        F.col("id").alias(id_col),
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """line_verdicts() with the dropped line numbers as text."""
    return line_verdicts(docs).select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS, short_chars: int = SHORT_CHARS, words_an_edit: int = WORDS_AN_EDIT) -> DataFrame:
    """The documents with their dropped lines gone; one that loses every non-blank line goes too."""
    lost = dropped_lines(docs, id_col, text_col, max_edits, near_chars, short_chars, words_an_edit).select(F.col("id").alias("__lost_id"), F.col("h").alias("__lost_h"), F.col("dropped").alias("__dropped"))
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col("__lost_id")) & (F.xxhash64(text_col) == F.col("__lost_h")), "left")
    parts = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(rebuilt)
    return joined.withColumn(text_col, text).where(F.col("__dropped").isNull() | (F.trim(F.regexp_replace(text_col, "\\n", "")) != "")).select(*docs.columns)
