"""HTTP as a source: a fetcher for crawls, and a Python data source."""

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from lexigrid.functions.urls import authority

HTML_TIMEOUT, FILE_TIMEOUT, DELAY = 20, 90, 0.5
AGENT = "Mozilla/5.0 (compatible; lexigrid/1.0)"
#: Types of content that are read as UTF-8, whatever their header says: many servers name a wrong character set, or none.
TEXT_TYPES = ("text", "xml", "html", "json")
BLOCK = 64 * 1024


def get(url: str, timeout: int = HTML_TIMEOUT) -> tuple[bytes, str, str | None] | None:
    """(body, content type, character set) of a response of status 200; else None."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Language": "vi,en;q=0.9"})  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
            if r.status != 200:
                return None
            body = b"".join(iter(lambda: r.read(BLOCK), b""))
            return body, r.headers.get_content_type(), r.headers.get_content_charset()
    except (OSError, urllib.error.URLError, ValueError):
        return None


def as_text(body: bytes, kind: str, charset: str | None) -> str:
    known = "utf-8" if any(t in kind for t in TEXT_TYPES) else charset or "latin-1"
    try:
        return body.decode(known, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def schedule(urls: DataFrame, delay: float = DELAY, order_by: list[str] | None = None) -> DataFrame:
    """urls with host, slot (a URL's place among those of its host, in the order of the columns or of the URL) and wait: the seconds after which
    it may be asked for at the earliest, so that no host is asked more often than once in `delay` seconds."""
    rows = urls.withColumn("host", authority(F.col("url")))
    slot = F.row_number().over(Window.partitionBy("host").orderBy(*(order_by or ["url"]))) - 1
    return rows.withColumn("slot", slot).withColumn("wait", F.col("slot") * F.lit(float(delay)))


def _politely(ask: Callable[[str], object], name: str, delay: float, clock=time.monotonic, sleep=time.sleep):
    """Batches of url, host in the order of their slots -> url and what ask gives. A host's requests lie `delay` seconds apart, as its task is the
    only one that asks it; while one host rests, the others' turns come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for batch in batches:
            for url, host in zip(batch["url"], batch["host"], strict=True):
                rest = free.get(host, 0.0) - clock()
                if rest > 0:
                    sleep(rest)
                free[host] = clock() + delay
                yield pd.DataFrame({"url": [url], name: [ask(url)]})
            now = clock()
            free = {h: t for h, t in free.items() if t > now}

    return run


def _fetcher(ask: Callable[[str], object], name: str, kind: str, delay: float) -> Callable[[DataFrame], DataFrame]:
    def fetch(urls: DataFrame) -> DataFrame:
        # hosts are dealt out to tasks; within a task they take turns
        planned = schedule(urls.select("url"), delay).repartition("host").sortWithinPartitions("slot", "host").select("url", "host")
        return planned.mapInPandas(_politely(ask, name, delay), f"url string, {name} {kind}")

    return fetch


def http_fetcher(delay: float = DELAY, timeout: int = HTML_TIMEOUT) -> Callable[[DataFrame], DataFrame]:
    """For crawling.bfs: url -> url, html. Requests to one host come one after another, `delay` seconds apart."""

    def ask(url: str) -> str | None:
        got = get(url, timeout)
        return as_text(*got) if got else None

    return _fetcher(ask, "html", "string", delay)


def http_file_fetcher(delay: float = DELAY, timeout: int = FILE_TIMEOUT) -> Callable[[DataFrame], DataFrame]:
    """For flows.crawl: url -> url, content; as http_fetcher."""

    def ask(url: str) -> bytes | None:
        got = get(url, timeout)
        return got[0] if got else None

    return _fetcher(ask, "content", "binary", delay)


class HttpSource(DataSource):
    """spark.dataSource.register(HttpSource); spark.read.format("http_pages").option("urls", "a b c").load(): url, status, content."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, ok boolean, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = options.get("urls", "").split()
        self.timeout = int(options.get("timeout", FILE_TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            got = get(partition.value, self.timeout)
            yield partition.value, got is not None, got[0] if got else None
