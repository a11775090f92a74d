"""Fetching pages: a polite GET with retries, and a Python data source that reads addresses in parallel."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tries, seconds to wait for an answer, client errors that are worth another try.
ATTEMPTS, TIMEOUT, RETRY_STATUS = 3, 20, (408, 429)


def fetch(url: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, pause: float = 1.0) -> tuple[int | None, bytes | None, str | None]:
    """(status, content, error). Client errors are final but for two; waits grow with each try."""
    status, error = None, None
    for n in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "plinth"}), timeout=timeout) as answer:
                return answer.status, answer.read(), None
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if 400 <= e.code < 500 and e.code not in RETRY_STATUS:
                break
        except (OSError, ValueError) as e:
            error = str(e)
            if isinstance(e, ValueError):
                break
        if n < attempts:
            time.sleep(pause * n)
    return status, None, error


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageSource(DataSource):
    """``spark.read.format("plinth_pages")`` with options urls (a JSON list), partitions, attempts, timeout and pause."""

    @classmethod
    def name(cls) -> str:
        return "plinth_pages"

    def schema(self) -> str:
        return "url string, status int, content binary, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options["urls"])
        self.n = max(1, min(int(options.get("partitions", 8)), len(self.urls) or 1))
        self.attempts, self.timeout, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT)), float(options.get("pause", 0.5))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.urls[i :: self.n]) for i in range(self.n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(self.pause)
            yield (url, *fetch(url, self.attempts, self.timeout, self.pause))


def read_pages(spark: SparkSession, urls: list[str], **options: str | int | float) -> DataFrame:
    """Pages of a crawl frontier; what could not be read has an error and no content."""
    spark.dataSource.register(PageSource)
    return spark.read.format("plinth_pages").options(urls=json.dumps(urls), **{k: str(v) for k, v in options.items()}).load()
