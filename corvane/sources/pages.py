"""SRC-18: an external store that gives its rows in pages, as a data source: a partition for each range of pages, the tenant's filter pushed to the store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Client(Protocol):
    """What a store's client offers. tenant is None for all tenants; rows come in one stable order of the store's, so that an offset means the same on each executor."""

    def count(self, tenant: str | None) -> int: ...

    def page(self, tenant: str | None, offset: int, limit: int) -> list[dict]: ...


@dataclass
class Pages(InputPartition):
    tenant: str | None
    start: int
    end: int


class PagedStore(DataSource):
    """spark.read.format("paged_store"): options client (module:name of a function that takes the option address and makes a client), address, page (rows a request, 500 by default), pages (requests a partition, 8 by default). The schema is given by the reader's caller and has a column tenant for the filter to be pushed."""

    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> str:
        return "tenant string, id string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema_, self.tenant = dict(options), schema, None
        self.size, self.many = int(options.get("page", 500)), int(options.get("pages", 8))
        if self.size < 1 or self.many < 1:
            raise ValueError("page and pages have to be 1 at least")

    def client(self) -> Client:
        module, _, name = self.options["client"].partition(":")
        return getattr(import_module(module), name)(self.options.get("address"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes tenant = value, once; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tenant",) and isinstance(f.value, str) and self.tenant is None:
                self.tenant = f.value
            else:
                yield f

    def partitions(self) -> list[Pages]:
        n, step = self.client().count(self.tenant), self.size * self.many
        return [Pages(self.tenant, a, min(n, a + step)) for a in range(0, n, step)] or [Pages(self.tenant, 0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """A batch a page; a page that comes back short is an error, since rows would be missing."""
        client, shape = self.client(), to_arrow_schema(self.schema_)
        for at in range(partition.start, partition.end, self.size):
            want = min(self.size, partition.end - at)
            rows = client.page(partition.tenant, at, want)
            if len(rows) != want:
                raise ValueError(f"the store gave {len(rows)} of {want} rows at {at}")
            yield pa.RecordBatch.from_pylist([{name: r.get(name) for name in shape.names} for r in rows], shape)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters be pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedStore)
