"""A data source of paginated JSON services: each start page's chain is a partition, read on executors page by page.

    spark.dataSource.register(PagedSource)
    spark.read.format("touchline_pages").option("urls", "https://...").option("columns", "time,m").load()

A page is an object with the rows in ``data`` and the next page's address, if there is one, in
``next_page_url`` (it may be relative).  A page that repeats within its chain, or is empty, fails the read.  Values are
strings, as ``read_pages`` gives them; the chain is followed again if a task is lost.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .readers import feed


def fetch(url: str) -> dict:
    """A page at an address or in a file that executors share."""
    with urllib.request.urlopen(url if "://" in url else f"file://{urllib.parse.quote(url)}", timeout=60) as response:
        return json.load(response)


def pages(url: str | None, get=fetch) -> Iterator[list[dict]]:
    """The rows of each page of a chain, one page at a time."""
    seen: set[str] = set()
    while url:
        if url in seen:
            raise ValueError(f"the page {url} repeats")
        seen.add(url)
        page = get(url)
        if not page.get("data"):
            raise ValueError(f"the page {url} is empty")
        yield page["data"]
        following = page.get("next_page_url")
        url = urllib.parse.urljoin(url, following) if following else None


class _Chain(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], columns: list[str]):
        self.urls, self.columns = urls, columns

    def partitions(self) -> list[_Chain]:
        return [_Chain(u) for u in self.urls]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        for rows in pages(partition.url):
            for r in rows:
                yield tuple(None if r.get(c) is None else str(r[c]) for c in self.columns)


class PagedSource(DataSource):
    """Options: urls (start pages, separated by white space), columns (names, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "touchline_pages"

    def _columns(self) -> list[str]:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if not names:
            raise ValueError("the option columns names none")
        return names

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        urls = self.options.get("urls", "").split()
        if not urls:
            raise ValueError("the option urls names no page")
        return _Reader(urls, [f.name for f in schema.fields])


def read_paged(spark: SparkSession, urls: list[str], ts: str, metrics: dict[str, str]) -> DataFrame:
    """Metrics of paginated services as an auxiliary series; ``metrics`` maps names of the service to panel names."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format(PagedSource.name()).option("urls", " ".join(urls)).option("columns", ",".join([ts, *metrics])).load()
    return feed(rows, metrics, ts)
