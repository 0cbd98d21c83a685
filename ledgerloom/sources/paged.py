"""A paged source: a Python data source with one partition per page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageReader(DataSourceReader):
    """Reads pages [start, start + rows) of a service that answers {'total': n, 'result': [...]} .

    Options: ``url`` (http(s) or file), ``rows`` per page, ``sort`` (a stable
    key, so that pages do not overlap), ``total``.  A file URL holds all records
    and is paged here, which serves tests and saved snapshots.
    """

    def __init__(self, schema, options: dict[str, str]) -> None:
        self.names = [f.name for f in schema]
        self.url = options["url"]
        self.rows = int(options.get("rows", "5000"))
        self.sort = options.get("sort")
        self.total = int(options["total"]) if "total" in options else None

    def _page(self, start: int, rows: int) -> dict:
        if self.url.startswith("file:"):
            with urlopen(self.url) as f:
                records = json.load(f)["result"]
            if self.sort:
                records = sorted(records, key=lambda r: r[self.sort])
            return {"total": len(records), "result": records[start : start + rows]}
        query = urlencode({"start": start, "rows": rows} | ({"sort": self.sort} if self.sort else {}))
        with urlopen(f"{self.url}?{query}") as f:
            return json.load(f)

    def partitions(self) -> list[InputPartition]:
        total = self.total if self.total is not None else self._page(0, 1)["total"]
        return [InputPartition(start) for start in range(0, total, self.rows)] or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for record in self._page(partition.value, self.rows)["result"]:
            yield tuple(record.get(n) for n in self.names)


class PagedSource(DataSource):
    """``spark.read.format('paged')`` once registered by ``spark.dataSource.register(PagedSource)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return PageReader(schema, dict(self.options))
