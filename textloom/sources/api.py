"""Paged record sources over landed pages.

A harvester lands each response as a file; ``paged_records`` follows the pages from the first by
their cursor or token, as the services would hand them out, and stops at an empty page, a missing or
repeated cursor, or an unreadable page. Pages form a chain, so one task reads them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Per service: where its records are, the key of the next cursor, and the first cursor.
SERVICES = {
    "literature": (("resultList", "result"), "nextCursorMark", "*"),
    "trials": (("studies",), "nextPageToken", ""),
}


def follow(folder: str, service: str, quota: int | None = None) -> Iterator[dict]:
    """Records of the chain of pages ``<cursor>.json`` (``first.json`` for the first cursor)."""
    keys, next_key, cursor = SERVICES[service]
    seen, n = set(), 0
    name = "first"
    while name not in seen:
        seen.add(name)
        try:
            with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
                page = json.load(f)
        except (OSError, ValueError):
            return
        records, following = page, page.get(next_key)
        for k in keys:
            records = (records or {}).get(k) if isinstance(records, dict) else None
        if not records:
            return
        for r in records:
            if quota is not None and n >= quota:
                return
            n += 1
            yield r
        if not following or following == cursor:
            return
        cursor, name = following, following


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        quota = self.options.get("quota")
        for r in follow(self.options["path"], self.options["service"], int(quota) if quota else None):
            yield (json.dumps(r, ensure_ascii=False),)


class PagedRecords(DataSource):
    """``spark.read.format("paged_records").option("service", …).load(folder)``: a column ``value`` of JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRecords)
