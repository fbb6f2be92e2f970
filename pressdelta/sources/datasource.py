"""Web sources as Spark data sources: ``spark.read.format("pressdelta-candidates")`` and its stream.

Addresses are given in the option ``urls``, one a line. Those of one host are one
partition, so a host is asked by one task at a time, however many tasks there are.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import fetch as FE
from . import markup as M

RESPONSES, CANDIDATES = "pressdelta-responses", "pressdelta-candidates"


def _answered(urls: list[str], get: FE.Get) -> Iterator[tuple]:
    return (FE.response(url, get) for url in urls)


def _found(urls: list[str], get: FE.Get) -> Iterator[tuple]:
    for _, url, kind, body, error in _answered(urls, get):
        if error is None:
            yield from M.listed(url, body, M.looks_xml(kind, url))


def by_host(urls: list[str]) -> list[list[str]]:
    """The addresses of each host, every address once, hosts and addresses in order."""
    hosts: dict[str, dict[str, None]] = {}
    for url in urls:
        hosts.setdefault((urlsplit(url).hostname or "").lower(), {})[url] = None
    return [list(found) for _, found in sorted(hosts.items())]


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], rows, get: FE.Get):
        self.urls, self.rows, self.get = urls, rows, get

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(urls) for urls in by_host(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(self.rows(partition.value, self.get))


class _Polls(DataSourceStreamReader):
    """One batch for each poll interval that has begun; a batch that is repeated asks again."""

    def __init__(self, urls: list[str], rows, get: FE.Get, seconds: float, now=time.time):
        self.urls, self.rows, self.get, self.seconds, self.now = urls, rows, get, seconds, now

    def initialOffset(self) -> dict:
        return {"poll": int(self.now() // self.seconds) - 1}

    def latestOffset(self) -> dict:
        return {"poll": int(self.now() // self.seconds)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(urls) for urls in by_host(self.urls)] if end["poll"] > start["poll"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return iter(self.rows(partition.value, self.get))


def sources(get: FE.Get = FE.http_get) -> list[type[DataSource]]:
    """The data sources with a way to fetch."""

    class Web(DataSource):
        rows: object
        kind: str

        def schema(self) -> str:
            return self.kind

        def _urls(self) -> list[str]:
            found = [u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()]
            if not found:
                raise ValueError("option urls names no address")
            return found

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self._urls(), type(self).rows, get)

        def streamReader(self, schema) -> DataSourceStreamReader:
            seconds = 60 * float(self.options.get("minutes", "60"))
            if seconds <= 0:
                raise ValueError("option minutes must be positive")
            return _Polls(self._urls(), type(self).rows, get, seconds)

    class Responses(Web):
        rows, kind = staticmethod(_answered), FE.RESPONSE

        @classmethod
        def name(cls) -> str:
            return RESPONSES

    class Candidates(Web):
        rows, kind = staticmethod(_found), M.CANDIDATE

        @classmethod
        def name(cls) -> str:
            return CANDIDATES

    return [Responses, Candidates]


def register(spark: SparkSession, get: FE.Get = FE.http_get) -> None:
    """Make the sources known to a session by their names."""
    for source in sources(get):
        spark.dataSource.register(source)
