"""A Spark data source over a service that gives its rows page by page.

Each page is one partition, so pages are fetched by the executors at once; nothing passes through the driver but the
number of pages. ``fetch`` is any importable function (page number, options) -> (rows, number of pages), named in the
options as ``module:function``; the tests use a local one.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), dict(options)

    def _fetch(self, number: int) -> tuple[list[dict], int]:
        module, name = self.options["fetch"].split(":")
        return getattr(importlib.import_module(module), name)(number, self.options)

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(1, self._fetch(1)[1] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self._fetch(partition.number)[0]:
            yield tuple(row.get(n) for n in self.names)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged").schema(s).option("fetch", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)
