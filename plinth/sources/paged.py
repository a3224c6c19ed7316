"""Paged sources as a Python data source: one partition a page, projection and simple predicates asked of the source, retries (OP-S13, S17).

A source is a template of addresses with {page}; a page is a file of JSON lines, read through Arrow's file systems. What the source is
asked for is what leaves a task: the wanted columns of rows that meet the equality tests, which Spark pushes down.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import StructType


def with_retries(fetch: Callable[[], bytes], tries: int = 4, wait: float = 0.2) -> bytes:
    """OP-S17: what fetch gives; a failure that may pass (OSError, and so timeouts and broken connections) is tried again after a pause
    that doubles, the last one goes out."""
    for i in range(tries):
        try:
            return fetch()
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    raise ValueError("tries must be at least 1")


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.template, self.pages, self.tries = options["template"], int(options["pages"]), int(options.get("tries", "4"))
        self.fails = int(options.get("failsfirst", "0"))  # for tests: how often each page fails first
        self.names = schema.names
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters):
        """Equality tests on columns are asked of the source; Spark does the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        from pyarrow import fs

        left = [self.fails]

        def fetch() -> bytes:
            if left[0] > 0:
                left[0] -= 1
                raise ConnectionError("not now")
            system, path = fs.FileSystem.from_uri(self.template.replace("{page}", str(partition.number)))
            with system.open_input_stream(path) as f:
                return f.read()

        for line in with_retries(fetch, self.tries, 0.01).decode("utf-8").splitlines():
            row = json.loads(line)
            if all(row.get(c) == v for c, v in self.equal.items()):
                yield tuple(row.get(c) for c in self.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plinth_pages"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def read_pages(spark: SparkSession, template: str, pages: int, schema: str, where: tuple[str, str] | None = None, **options) -> DataFrame:
    """OP-S13: the pages 0 to pages - 1 of a source, with the columns of schema; where: a column and the value that it has to have."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    df = spark.read.format("plinth_pages").schema(schema).options(template=template, pages=str(pages), **{k: str(v) for k, v in options.items()}).load()
    return df if where is None else df.where(df[where[0]] == where[1])
