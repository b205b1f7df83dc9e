"""Text of PDF pages out of positioned words: words inside tables are left to the tables, the rest is put in reading order.

A reader of PDF files gives the words and the tables' boxes; everything after that is relational."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions.text import strip
from textloom.operators.extract import render_table
from textloom.session import ship_package

#: Words whose tops follow each other at no more than this distance share a line.
LINE_GAP = 3.0


@F.pandas_udf(StringType())
def _rendered(tables: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in tables:
        yield batch.map(lambda rows: render_table([list(r) for r in rows if r is not None] if rows is not None else []))


def outside_tables(words: DataFrame, tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The words whose centre lies in no table of their page, borders included: an anti-join by page and containment."""
    boxes = tables.select(F.col(id_col).alias("_id"), F.col("page").alias("_page"), *(F.col(c).alias(f"_{c}") for c in ("x0", "x1", "top", "bottom")))
    across, down = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    held = across.between(F.col("_x0"), F.col("_x1")) & down.between(F.col("_top"), F.col("_bottom"))
    return words.join(boxes, (F.col(id_col) == F.col("_id")) & (F.col("page") == F.col("_page")) & held, "left_anti")


def page_lines(words: DataFrame, id_col: str = "doc_id", gap: float = LINE_GAP) -> DataFrame:
    """(id, page, line, text): words in lines from top to bottom, in a line from left to right."""
    down = Window.partitionBy(id_col, "page").orderBy("top", "x0", "text")
    falls = F.coalesce((F.col("top") - F.lag("top").over(down) > gap).cast("int"), F.lit(0))
    lines = words.withColumn("_falls", falls).withColumn("line", F.sum("_falls").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    placed = F.sort_array(F.collect_list(F.struct("x0", "top", "text")))
    return lines.groupBy(id_col, "page", "line").agg(F.array_join(F.transform(placed, lambda w: w["text"]), " ").alias("text"))


def page_texts(words: DataFrame, tables: DataFrame, id_col: str = "doc_id", gap: float = LINE_GAP) -> DataFrame:
    """(id, text) of every document with words or tables: page by page the prose, then the page's tables, blank lines dropped.

    words: (id, page, x0, x1, top, bottom, text); tables: (id, page, table_no, x0, x1, top, bottom, rows), rows an
    array of arrays of cells. Windows and groups hold the words of one page; a document's blocks meet once."""
    ship_package(words.sparkSession)
    prose = page_lines(outside_tables(words.where("text IS NOT NULL"), tables, id_col), id_col, gap).select(id_col, "page", F.lit(-1).alias("table_no"), "line", "text")
    drawn = tables.select(id_col, "page", F.col("table_no").cast("int").alias("table_no"), F.lit(0).cast("bigint").alias("line"), _rendered("rows").alias("text"))
    seen = words.select(id_col).union(tables.select(id_col)).distinct()
    blocks = prose.unionByName(drawn).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("page", "table_no", "line", "text"))).alias("blocks"))
    lines = F.flatten(F.transform("blocks", lambda b: F.split(b["text"], "\n")))
    text = F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")
    return seen.join(blocks, id_col, "left").select(id_col, F.coalesce(text, F.lit("")).alias("text"))
