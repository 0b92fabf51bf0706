"""A data source for pages of one host, fetched at no more than a set rate."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAUSE, TIMEOUT = 0.12, 30


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.agent = options.get("agent", "")
        if "@" not in self.agent and any(u.startswith("http") for u in self.urls):
            raise ValueError("the agent must name an address (name@host)")

    def partitions(self) -> list[InputPartition]:
        """One for each host, so that the rate holds however many tasks there are."""
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(u.split("/")[2] if "//" in u else "", []).append(u)
        return [InputPartition(x) for x in hosts.values()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for u in partition.value:
            time.sleep(PAUSE)
            try:
                with urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": self.agent or "none"}), timeout=TIMEOUT) as r:
                    yield u, r.read().decode("utf-8", "replace"), None
            except OSError as e:
                yield u, None, str(e)


class Pages(DataSource):
    """spark.read.format("pages").option("urls", "...").option("agent", "...").load(): url, body and error of each page."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
