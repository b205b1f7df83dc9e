"""Sections of a text: by "Item" headers, else by numbered headings, else none.

Headers are found on whole texts (they may span lines) by writing sentinel characters around
each match and splitting on them, so one narrow expression per document does it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import bound, strip

# Heading patterns, and how many headings make a split trustworthy.
ITEM_HEADER = "^\\s*(Item\\s+\\d+[A-Za-z]?(?:\\.\\d+)?\\.?\\s+[A-Z][A-Za-z0-9 ,.'&/\\-]{2,90})\\s*$"
ITEM_NUMBER = "(?i)^item\\s+\\d+[a-z]?(?:\\.\\d+)?"
NUMBERED_HEADING = (
    "^\\s*((?:Section\\s+|Appendix\\s+|Annex\\s+)?(?:\\d+(?:\\.\\d+){0,2}\\.?|[A-Z]\\.)\\s+"
    "[A-Z][A-Za-z0-9 ,'&/()-]{2,68}[A-Za-z0-9)])\\s*$"
)
MIN_SECTIONS = 3
WHOLE, FRONT = "Full Document", "Front Matter"

#: Control characters, which cleaned texts do not hold: match start, title start, title end.
START, TITLE, END = "\x01", "\x02", "\x03"


def collapse(col: Column) -> Column:
    return F.regexp_replace(col, "(?U)\\s+", " ")


def item_key(title: Column) -> Column:
    """The "item <number>" prefix of a title in lower case, else the whole title in lower case."""
    found = F.regexp_extract(strip(title), ITEM_NUMBER, 0)
    return F.when(found != "", collapse(F.lower(found))).otherwise(F.lower(strip(title)))


def pieces(text: Column, pattern: str, flags: str) -> Column:
    """structs (title, whole, rest): text before the first match (title null), then each match with what follows."""
    marked = F.regexp_replace(text, f"(?{flags}){pattern}", f"{START}$0{TITLE}$1{END}")
    return F.transform(
        F.split(marked, START),
        lambda x, i: F.when(i == 0, F.struct(F.lit(None).cast("string").alias("title"), F.lit("").alias("whole"), x.alias("rest"))).otherwise(
            F.struct(
                F.substring_index(F.substring_index(x, END, 1), TITLE, -1).alias("title"),
                F.substring_index(x, TITLE, 1).alias("whole"),
                F.substring_index(x, END, -1).alias("rest"),
            )
        ),
    )


def _item_sections(text: Column) -> Column:
    """Sections by Item headers: of a run of one key the first stays, of one key's runs the last.

    Dropped headers stay text of the section around them; text before the first is lost."""
    all_pieces = F.slice(pieces(text, ITEM_HEADER, "dim"), 2, 1_000_000_000)
    keyed = F.transform(all_pieces, lambda p: F.struct(p["title"].alias("title"), p["whole"].alias("whole"), p["rest"].alias("rest"), item_key(p["title"]).alias("key")))

    def last_runs(found: Column) -> Column:
        """Places of the first header of each key's last run, in order."""
        starts_run = lambda i: (i == 0) | (F.get(found, i)["key"] != F.get(found, F.greatest(i - 1, F.lit(0)))["key"])
        heads = F.array_sort(F.filter(F.transform(found, lambda p, i: F.when(starts_run(i), F.struct(p["key"].alias("key"), i.alias("i")))), lambda p: p.isNotNull()))
        # sorted by key, then place: the last of a key is followed by another key
        final = lambda s: F.filter(s, lambda p, j: F.coalesce(F.get(s, j + 1)["key"] != p["key"], F.lit(True)))
        return F.array_sort(F.transform(bound(heads, final), lambda p: p["i"]))

    def cut(found: Column, last: Column) -> Column:
        following = lambda i, end: F.transform(F.slice(found, i + 2, F.coalesce(end, F.size(found)) - i - 1), lambda p: F.concat(p["whole"], p["rest"]))
        body = lambda i, k: F.concat(F.get(found, i)["rest"], F.array_join(following(i, F.get(last, k + 1)), ""))
        made = F.transform(last, lambda i, k: F.struct(collapse(strip(F.get(found, i)["title"])).alias("title"), strip(body(i, k)).alias("body")))
        return F.when(F.size(last) >= MIN_SECTIONS, F.filter(made, lambda s: s["body"] != ""))

    return bound(keyed, lambda found: bound(last_runs(found), lambda last: cut(found, last)))


def _numbered_sections(text: Column) -> Column:
    """Sections by numbered headings; text before the first is front matter."""
    made = lambda p: F.struct(F.coalesce(collapse(strip(p["title"])), F.lit(FRONT)).alias("title"), strip(p["rest"]).alias("body"))
    cut = lambda found: F.when(F.size(found) - 1 >= MIN_SECTIONS, F.filter(F.transform(found, made), lambda s: s["body"] != ""))
    return bound(pieces(text, NUMBERED_HEADING, "dm"), cut)


def sections(text: Column) -> Column:
    """array<struct<title, body>> of a cleaned text."""
    whole = F.array(F.struct(F.lit(WHOLE).alias("title"), text.alias("body")))
    return F.coalesce(_item_sections(text), _numbered_sections(text), whole)


def split_sections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per section: the other columns, sec_pos from 0, section, body."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(sections(F.col(text_col))).alias("sec_pos", "s")).select(*others, "sec_pos", F.col("s.title").alias("section"), F.col("s.body").alias("body"))
