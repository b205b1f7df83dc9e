"""Column expressions for cleaning and reading text; all stay inside one row and in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.session import ship_package

# Characters that mean the same, written one way; the last three are deleted.
QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
DASHES = "‐‑‒–—―−"
SPACES = "   "
INVISIBLE = "​﻿­"
PUNCTUATION_FROM = QUOTES + DOUBLE_QUOTES + DASHES + SPACES + INVISIBLE
PUNCTUATION_TO = "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES)
# Patterns and limits of the cleaning rules.
CONTROL_CHARS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
HYPHENATED = "([A-Za-z]{2,})-\\n([a-z]{2,})"
DOT_LEADER = "\\.{4,}\\s*\\d*\\s*$"
PAGE_NUMBER = "(?i)^(?:page\\s*)?\\d{1,4}$"
FURNITURE_CHARS = (15, 80)
FURNITURE_WORDS = 10
FURNITURE_REPEATS = 5
# Tokens per word where no tokenizer is at hand; sentence ends; search tokens.
TOKENS_PER_WORD = 1.6
SENTENCE_END = "(?:(?<=[.!?])|(?<=[.!?][\"')\\]]))\\s+(?=[A-Z0-9])"
SEARCH_TOKEN = "[a-z0-9]+"

#: Line ends other than the control characters that cleaning removes.
LINE_END = "\\r\\n|[\\n\\r\\x85\\u2028\\u2029]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: lambdas that name an expression would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Trims all Unicode white space, not only U+0020 as trim() does."""
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def words(col: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.array_remove(F.split(col, "(?U)\\s+"), "")


def n_words(col: Column) -> Column:
    return F.size(words(col))


def map_punctuation(col: Column) -> Column:
    return F.translate(col, PUNCTUATION_FROM, PUNCTUATION_TO)


def strip_controls(col: Column) -> Column:
    return F.regexp_replace(col, CONTROL_CHARS, "")


def join_hyphenated(col: Column) -> Column:
    return F.regexp_replace(col, HYPHENATED, "$1$2")


def lines_of(col: Column) -> Column:
    """Stripped non-blank lines with inner runs of blanks and tabs as one space."""
    return F.filter(F.transform(F.split(col, LINE_END), lambda x: F.regexp_replace(strip(x), "[ \\t]{2,}", " ")), lambda x: x != "")


@F.pandas_udf(StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(col: Column) -> Column:
    """Unicode NFKC, which Spark lacks, in Arrow batches; ASCII texts pass untouched."""
    ship_package(SparkSession.active())
    return _nfkc(col)


def is_table_row(line: Column) -> Column:
    return line.startswith("|")


def is_furniture_candidate(line: Column) -> Column:
    """Short label-shaped lines that may be page headers or footers."""
    low, high = FURNITURE_CHARS
    return ~is_table_row(line) & F.length(line).between(low, high) & (n_words(line) <= FURNITURE_WORDS)


def digit_mask(line: Column) -> Column:
    return F.regexp_replace(line, "\\d+", "#")


def frequent(items: Column, times: int) -> Column:
    """The places of an array's elements that are not null and occur at least so often, by one sort: no pairwise comparing."""
    placed = F.array_sort(F.filter(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"].isNotNull()))

    def of_run(s: Column) -> Column:
        # an element is one of `times` equal ones if some stretch of that many around it begins and ends alike
        alike = lambda i, k: (i >= k) & (F.get(s, F.greatest(i - k, F.lit(0)))["x"] == F.get(s, i - k + (times - 1))["x"])
        within = lambda i: F.coalesce(alike(i, 0), F.lit(False))
        hit = lambda i: within(i) if times == 1 else _any(F.coalesce(alike(i, k), F.lit(False)) for k in range(times))
        return F.transform(F.filter(s, lambda p, i: hit(i)), lambda p: p["i"])

    return bound(placed, of_run)


def _any(conditions: Iterator[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def kept_lines(lines: Column) -> Column:
    """Lines without page furniture, dot leaders and page numbers; table rows always stay.

    Linear in the number of lines but for one sort: furniture is told by place, not looked up per line."""

    def keep(own: Column) -> Column:
        templates = F.transform(own, lambda x: F.when(is_furniture_candidate(x), digit_mask(x)))
        fillers = F.transform(own, lambda x, i: F.when(~is_table_row(x) & (x.rlike(DOT_LEADER) | x.rlike(PAGE_NUMBER)), i))
        places = F.transform(own, lambda x, i: i)
        kept = F.array_except(F.array_except(places, frequent(templates, FURNITURE_REPEATS)), fillers)
        return F.transform(kept, lambda i: F.get(own, i))

    return bound(lines, keep)


def clean_characters(col: Column) -> Column:
    """All cleaning that works on characters, NFKC excepted."""
    return join_hyphenated(strip_controls(map_punctuation(col)))


def normalise_text(col: Column) -> Column:
    """A cleaned text: one stripped line per line, furniture and fillers gone. NFKC is a step before it."""
    return F.array_join(kept_lines(lines_of(clean_characters(col))), "\n")


def normalise_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their text cleaned, NFKC included.

    NFKC runs in Python, so it is a projection of its own; the rest stays in the JVM."""
    return df.withColumn(text_col, nfkc(F.col(text_col))).withColumn(text_col, normalise_text(F.col(text_col)))


def token_count(col: Column) -> Column:
    """Estimated model tokens from the number of words."""
    return (F.floor(n_words(col) * F.lit(TOKENS_PER_WORD)) + 1).cast("int")


def sentences(col: Column) -> Column:
    return F.filter(F.split(col, SENTENCE_END), lambda x: strip(x) != "")


def search_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(SEARCH_TOKEN), F.lit(0))


def content_key(col: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(col.cast("binary"), 256)


def snippet(col: Column, size: int = 140) -> Column:
    return F.translate(F.substring(col, 1, size), "\n", " ")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is zero or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
