"""Chunks of bounded size: sentences packed with overlap, tables split under a repeated header."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import TOKENS_PER_WORD, bound, is_table_row, n_words, sentences, strip, token_count, words
from textloom.functions.workers import held
from textloom.operators.sections import WHOLE
from textloom.session import ship_package

# Token budgets of a chunk, of the overlap, and held back for the header.
MAX_TOKENS = 360
OVERLAP_TOKENS = 60
HEADER_RESERVE = 60

Counter = Callable[[Column], Column]


def split_blocks(text: Column) -> Column:
    """array<struct<kind, body>>: runs of table rows and of other lines, blank ones dropped."""
    rows = F.split(text, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    kind = lambda x: F.when(is_table_row(x), F.lit("table")).otherwise(F.lit("prose"))

    def blocks(lines: Column) -> Column:
        begins = lambda x, i: (i == 0) | (is_table_row(x) != is_table_row(F.get(lines, F.greatest(i - 1, F.lit(0)))))
        starts = F.filter(F.transform(lines, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
        body = lambda i, end: F.array_join(F.slice(lines, i + 1, F.coalesce(end, F.size(lines)) - i), "\n")
        return bound(starts, lambda s: F.transform(s, lambda i, k: F.struct(kind(F.get(lines, i)).alias("kind"), body(i, F.get(s, k + 1)).alias("body"))))

    return F.filter(bound(rows, blocks), lambda b: strip(b["body"]) != "")


def split_oversized(unit: Column, max_tokens: Column | int, count: Counter = token_count) -> Column:
    """A unit as word windows that fit the budget by the unit's own tokens per word."""
    budget = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens

    def windows(each: Column, n: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(budget / (n / F.greatest(F.size(each), F.lit(1)))).cast("int"))
        starts = lambda by: F.transform(F.sequence(F.lit(1), F.greatest(F.size(each), F.lit(1)), by), lambda i: F.array_join(F.slice(each, i, by), " "))
        return bound(step, starts)

    def fitted(n: Column) -> Column:
        return F.when(n <= budget, F.array(unit)).otherwise(bound(words(unit), lambda each: F.when(F.size(each) <= 1, F.array(unit)).otherwise(windows(each, n))))

    return bound(count(unit), fitted)


def pack(units: Column, budget: int, overlap: int, count: Counter) -> Column:
    """Greedy packing of ordered units (text), carrying whole trailing units of at most `overlap` tokens.

    One ordered fold per row; its state is the finished chunks, the open one and how many
    tokens have gone by. An open unit knows how many went before it, so the size of any tail
    of the open chunk is one subtraction."""
    sized = F.transform(units, lambda u: F.struct(u.alias("u"), count(u).alias("n")))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<u:string,before:int>>").alias("open"), F.lit(0).alias("passed"))
    joined = lambda open_: F.array_join(F.transform(open_, lambda y: y["u"]), " ")

    def step(acc: Column, x: Column) -> Column:
        passed, item = acc["passed"], F.struct(x["u"].alias("u"), acc["passed"].alias("before"))
        over = (F.size(acc["open"]) > 0) & (passed - F.get(acc["open"], F.lit(0))["before"] + x["n"] > budget)
        # sizes are positive, so the tails that fit are a run of lengths from 0
        tail = F.filter(acc["open"], lambda y: passed - y["before"] <= overlap)
        return F.when(
            over,
            F.struct(F.concat(acc["done"], F.array(joined(acc["open"]))).alias("done"), F.concat(tail, F.array(item)).alias("open"), (passed + x["n"]).alias("passed")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(item)).alias("open"), (passed + x["n"]).alias("passed")))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(joined(acc["open"])))).otherwise(acc["done"])

    return F.aggregate(sized, zero, step, finish)


def chunk_prose(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Counter = token_count) -> Column:
    """Sentences packed into chunks; one sentence beyond the budget is split by words first."""
    units = F.flatten(F.transform(sentences(strip(text)), lambda s: split_oversized(s, max_tokens, count)))
    return pack(units, max_tokens, overlap, count)


def chunk_table(table: Column, max_tokens: int = MAX_TOKENS, count: Counter = token_count) -> Column:
    """A table in parts that each start with its header (two lines when the second is a rule)."""
    def split(lines: Column) -> Column:
        ruled = F.coalesce(F.get(lines, F.lit(1)).rlike("^[-| ]*$"), F.lit(False))
        size = F.when(ruled, 2).otherwise(1)
        header = F.array_join(F.slice(lines, F.lit(1), size), "\n")
        rows = F.slice(lines, size + 1, F.greatest(F.size(lines) - size, F.lit(0)))
        return bound(header, lambda h: bound(count(h), lambda cost: parts(h, cost, rows)))

    def parts(header: Column, cost: Column, rows: Column) -> Column:
        fitting = F.flatten(F.transform(rows, lambda r: split_oversized(r, F.lit(max_tokens) - cost, count)))
        sized = F.transform(fitting, lambda r: F.struct(r.alias("u"), count(r).alias("n")))
        zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
        part = lambda open_: F.array_join(F.concat(F.array(header), open_), "\n")

        def step(acc: Column, x: Column) -> Column:
            over = (F.size(acc["open"]) > 0) & (cost + acc["size"] + x["n"] > max_tokens)
            return F.struct(
                F.when(over, F.concat(acc["done"], F.array(part(acc["open"])))).otherwise(acc["done"]).alias("done"),
                F.when(over, F.array(x["u"])).otherwise(F.concat(acc["open"], F.array(x["u"]))).alias("open"),
                F.when(over, x["n"]).otherwise(acc["size"] + x["n"]).alias("size"),
            )

        return F.aggregate(sized, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(part(acc["open"])))).otherwise(acc["done"]))

    return F.when(count(table) <= max_tokens, F.array(table)).otherwise(bound(F.split(table, "\n"), split))


def chunk_section(text: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Counter = token_count) -> Column:
    """The chunks of a section's blocks, in order."""
    return F.flatten(
        F.transform(
            split_blocks(text),
            lambda b: F.when(b["kind"] == "table", chunk_table(b["body"], max_tokens, count)).otherwise(chunk_prose(b["body"], max_tokens, overlap, count)),
        )
    )


def embed_text(company: Column, form: Column, section: Column, text: Column) -> Column:
    """The text to embed: where it comes from, then the chunk."""
    led = F.concat_ws(" | ", F.nullif(company, F.lit("")), F.nullif(form, F.lit("")), F.when((section != WHOLE) & (section != ""), section))
    return F.when(led == "", text).otherwise(F.concat(led, F.lit("\n"), text))


def chunk_documents(sectioned: DataFrame, id_col: str = "doc_id", count: Counter = token_count) -> DataFrame:
    """One row per chunk of sectioned rows (id, sec_pos, section, body, further columns).

    chunk_index runs through a document's sections. Sections of a document come out of one
    row, so numbering needs the chunk counts of its sections only, not their texts."""
    others = [c for c in sectioned.columns if c not in ("body",)]
    parts = sectioned.select(*others, chunk_section(F.col("body"), count=count).alias("chunks"))
    before = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("sec_pos", F.size("chunks").alias("n")))).alias("sizes"))
    offset = F.aggregate(F.filter("sizes", lambda x: x["sec_pos"] < F.col("sec_pos")), F.lit(0), lambda acc, x: acc + x["n"])
    return (
        parts.join(before, id_col)
        .select(*others, offset.alias("offset"), F.posexplode("chunks").alias("chunk_pos", "text"))
        .withColumn("chunk_index", F.col("offset") + F.col("chunk_pos"))
        .withColumn("chunk_id", F.concat_ws("::", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")))
        .withColumn("word_count", n_words(F.col("text")))
        .drop("offset", "chunk_pos")
    )


def with_tokenizer(df: DataFrame, text_col: str, tokenizer: Callable[[str], int], out_col: str = "n_tokens") -> DataFrame:
    """Adds token counts by a caller's tokenizer, in Arrow batches; where it raises, the word estimate."""
    return _counted(df, text_col, out_col, lambda: tokenizer)


def with_built_tokenizer(df: DataFrame, text_col: str, name: str, factory: Callable[[], Callable[[str], int]], out_col: str = "n_tokens") -> DataFrame:
    """The same with a tokenizer that each worker builds once under that name; the word estimate where it cannot be built."""
    return _counted(df, text_col, out_col, lambda: held(name, factory))


def _counted(df: DataFrame, text_col: str, out_col: str, of: Callable[[], Callable[[str], int] | None]) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = of()
        for b in batches:
            out = []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                try:
                    out.append(int(tokenizer(t or "")))
                except Exception:
                    out.append(int(len((t or "").split()) * TOKENS_PER_WORD) + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, df.withColumn(out_col, F.lit(0)).schema)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, sections, chunks and the spread of their words."""
    return chunks.agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count_distinct("doc_id", "section").alias("sections"),
        F.count("*").alias("chunks"),
        F.min("word_count").alias("min_words"),
        F.max("word_count").alias("max_words"),
        F.avg("word_count").alias("mean_words"),
    )
