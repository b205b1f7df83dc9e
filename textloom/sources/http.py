"""HTTP documents as a Spark data source, with retries and an injectable transport."""

from __future__ import annotations

import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.session import ship_package

# Attempts, pauses, time-out; kinds of exhibits.
ATTEMPTS, COURTESY_S, BACKOFF_S, TIMEOUT_S = 4, 0.4, 1.5, 45
EXHIBIT = re.compile(r"^EX-(10|19|97)(\.\d+)?$", re.I)
EXHIBIT_KINDS = {"10": "contract", "19": "policy", "97": "policy"}

Transport = Callable[[str, dict[str, str], float], bytes]


def urlopen(url: str, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        return r.read()


def get(url: str, user_agent: str, attempts: int = ATTEMPTS, transport: Transport = urlopen, pause: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a URL; failures are tried again after growing pauses, the last one is raised."""
    for n in range(attempts):
        try:
            body = transport(url, {"User-Agent": user_agent}, TIMEOUT_S)
        except Exception:
            if n + 1 == attempts:
                raise
            pause(BACKOFF_S * 2**n)
        else:
            pause(COURTESY_S)
            return body
    raise ValueError("attempts must be positive")


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Url(u) for u in self.options["urls"].split("\n") if u]

    def read(self, partition: _Url) -> Iterator[tuple]:
        try:
            yield partition.url, get(partition.url, self.options.get("userAgent", "textloom")), None
        except Exception as e:
            yield partition.url, None, f"{type(e).__name__}: {e}"


class HttpDocuments(DataSource):
    """Format `http_documents`; option urls: one a line; a failed URL gives its error, not a failed job."""

    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self) -> str:
        return "url string, content binary, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpDocuments)


class _Rows(HTMLParser):
    """Rows of cells, each the pieces of text between its tags; text elsewhere is left out."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list[str]]] = []
        self.in_cell = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.rows[-1].append([])
        self.in_cell = tag == "td" or self.in_cell and tag != "tr"

    def handle_endtag(self, tag: str) -> None:
        self.in_cell = self.in_cell and tag not in ("td", "tr", "table")

    def handle_data(self, data: str) -> None:
        if self.in_cell and self.rows and self.rows[-1]:
            self.rows[-1][-1].append(data)


def find_exhibits(html: str) -> list[tuple[str, str, str]]:
    """(file name, exhibit type, kind) of the contracts and policies in a filing's index page."""
    reader = _Rows()
    reader.feed(html)
    found = []
    for cells in reader.rows:
        if len(cells) < 4:
            continue
        text = [" ".join("".join(c).split()) for c in cells]
        name = text[2].replace("iXBRL", "").strip()
        if (m := EXHIBIT.match(text[3])) and name.lower().endswith((".htm", ".html", ".txt")):
            found.append((name, text[3], EXHIBIT_KINDS[m.group(1)]))
    return found


@F.udtf(returnType="file_name string, exhibit_type string, kind string")
class ExhibitRows:
    """find_exhibits() as a table function."""

    def eval(self, html: str):
        yield from find_exhibits(html or "")


def exhibits(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row for each exhibit that an index page lists: the page's columns, file_name, exhibit_type, kind."""
    ship_package(pages.sparkSession)
    return pages.lateralJoin(ExhibitRows(F.col(html_col).outer()))
