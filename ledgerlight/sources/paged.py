"""Paged services as a data source: pages are partitions of a batch read, and offsets of a stream.

A fetcher, named as module:function, gives a page by number: fetch(page, options) returns a dict of pages (how many there are by now) and
records (list of dicts of texts). It runs in the tasks, so pages are read in parallel; Spark's checkpoint is the cursor. Fetchers over
recorded pages need no network. Sources of the tier 'paid' are refused.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed value: tiers that may be read.
TIERS = ("free", "recorded")
#: Pages of one partition.
EACH = 8


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _fetcher(options: dict):
    module, _, name = options["fetch"].partition(":")
    return getattr(importlib.import_module(module), name)


def _cut(first: int, last: int) -> list[Pages]:
    """Pages first to last in partitions of EACH."""
    return [Pages(a, min(a + EACH - 1, last)) for a in range(first, last + 1, EACH)]


def _records(options: dict, names: list[str], part: Pages) -> Iterator[tuple]:
    fetch = _fetcher(options)
    for page in range(part.first, part.last + 1):
        for place, record in enumerate(fetch(page, options)["records"]):
            text = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in record.items()}
            yield (page, place, *(text.get(n) for n in names[2:]))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[Pages]:
        return _cut(1, int(_fetcher(self.options)(1, self.options)["pages"]))

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _records(self.options, self.names, partition)


class _Stream(DataSourceStreamReader):
    """The offset is the number of pages that have been read; a page is whole once there is a later one or the service says so."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": int(_fetcher(self.options)(1, self.options)["pages"])}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _cut(start["pages"] + 1, end["pages"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _records(self.options, self.names, partition)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offset; there is nothing to tell the service."""


class PagedSource(DataSource):
    """Format 'paged'. Options: fetch (module:function), columns (names of texts, parted by commas), tier, and what the fetcher reads."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        if (tier := self.options.get("tier", "free")) not in TIERS:
            raise ValueError(f"source_refused: tier {tier}")
        return ", ".join(["page int", "place int", *(f"`{c.strip()}` string" for c in self.options["columns"].split(","))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
