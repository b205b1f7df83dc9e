"""Fetching documents from lists of addresses, over any transport, with errors kept beside the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.corpus import distinct_first, latest_filings, with_fetch_metadata
from textloom.session import ship_package

Transport = Callable[[str], bytes]


def filing_requests(submissions: DataFrame, depth: dict[str, int], address: str) -> DataFrame:
    """(cik, form, pos, filing_date, url, newest) of the last `depth[form]` filings of each form and company.

    submissions as for latest_filings(); address is a template with {cik}, {accession} and
    {document}. newest marks the filing that is a report itself; older ones serve for exhibits."""
    out: DataFrame | None = None
    for form, limit in depth.items():
        part = latest_filings(submissions, form, limit).withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    url = F.lit(address)
    for name, column in (("cik", F.col("cik").cast("string")), ("accession", F.replace(F.col("accessionNumber"), F.lit("-"), F.lit(""))), ("document", F.col("primaryDocument"))):
        url = F.replace(url, F.lit(f"{{{name}}}"), column)
    return out.select("cik", "form", "pos", F.col("filingDate").alias("filing_date"), url.alias("url"), (F.col("pos") == 0).alias("newest"))


def fetch(requests: DataFrame, transport: Transport, url_col: str = "url") -> DataFrame:
    """The requests with content and error; a failed one has an error and no content, and fails nothing else."""
    ship_package(requests.sparkSession)
    schema = requests.withColumn("content", F.lit(b"").cast("binary")).withColumn("error", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content: list[bytes | None] = []
            errors: list[str | None] = []
            for url in b.column(b.schema.get_field_index(url_col)).to_pylist():
                try:
                    content.append(transport(url))
                    errors.append(None)
                except Exception as e:
                    content.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=[*b.schema.names, "content", "error"])

    for f in schema:
        f.nullable = True
    return requests.mapInArrow(run, schema)


def fetched_documents(fetched: DataFrame, order: str, url_col: str = "url") -> DataFrame:
    """What was fetched, with its manifest columns; of one file stem the first in order stays."""
    named = fetched.where("error IS NULL").withColumn("local_path", F.substring_index(F.col(url_col), "/", -1))
    with_stem = with_fetch_metadata(named).withColumn("doc_id", F.regexp_replace("local_path", "\\.[^.]*$", ""))
    return distinct_first(with_stem, "doc_id", order)


def fetch_list(requests: DataFrame, transport: Transport, order: str, limit: int, url_col: str = "url") -> DataFrame:
    """The documents of the first `limit` addresses of a list, failures left out."""
    return fetched_documents(fetch(requests.orderBy(order).limit(limit), transport, url_col), order, url_col)
