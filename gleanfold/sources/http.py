"""Fetching as a Spark source: one task per request, errors as rows. Stored snapshots have the same columns."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "source string, mirror_rank int, url string, status int, body string, location string, error string, ms long"
# Limits of the client, its names, and what it accepts.
TIMEOUT_S, REDIRECTS = 10.0, 5
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36 Edg/124.0",
]
ACCEPTED = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}


def fetch(request: dict, timeout: float = TIMEOUT_S) -> tuple:
    """One request to one row of SCHEMA; never raises."""
    import random
    import urllib.error
    import urllib.request

    began = time.monotonic()
    body = json.dumps(request["json"]).encode() if request.get("json") is not None else None
    headers = ACCEPTED | {"User-Agent": random.choice(AGENTS)} | ({"Content-Type": "application/json"} if body else {}) | request.get("headers", {})

    class Limited(urllib.request.HTTPRedirectHandler):
        max_redirections = REDIRECTS

        def redirect_request(self, req, fp, code, msg, hdrs, newurl):
            return None if request.get("no_redirect") or newurl.startswith("magnet:") else super().redirect_request(req, fp, code, msg, hdrs, newurl)

    status, text, location, error = None, None, None, None
    try:
        with urllib.request.build_opener(Limited).open(urllib.request.Request(request["url"], body, headers), timeout=timeout) as r:
            status, text = r.status, r.read().decode(request.get("encoding", "utf-8"), "replace")
    except urllib.error.HTTPError as e:
        status, location, error = e.code, e.headers.get("Location"), None if e.headers.get("Location") else f"HTTP {e.code}"
    except Exception as e:  # noqa: BLE001  a source's failure is a row
        error = str(getattr(e, "reason", "") or e) or "request_failed"
    return request["source"], int(request.get("mirror_rank", 0)), request["url"], status, text, location, error, int(1000 * (time.monotonic() - began))


class _Request(InputPartition):
    def __init__(self, request: dict):
        super().__init__(request)
        self.request = request


def sources_of(filters: list[Filter], wanted: set[str] | None) -> tuple[set[str] | None, list[Filter]]:
    """The sources that filters on the column source leave (None: all), and the filters that say anything else."""
    rest = []
    for f in filters:
        if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            wanted = named if wanted is None else wanted & named
        else:
            rest.append(f)
    return wanted, rest


def prune_sources(spark: SparkSession, source: type[DataSource]) -> None:
    """Register a data source whose readers leave out the sources that a filter rules out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


class _Reader(DataSourceReader):
    wanted: set[str] | None = None

    def __init__(self, options):
        self.requests, self.timeout = json.loads(options.get("requests", "[]")), float(options.get("timeout", TIMEOUT_S))

    def pushFilters(self, filters):  # noqa: N802
        """A filter on the source spares the requests to all others."""
        self.wanted, rest = sources_of(filters, self.wanted)
        return rest

    def partitions(self):
        return [_Request(r) for r in self.requests if self.wanted is None or r["source"] in self.wanted] or [_Request({})]

    def read(self, partition):
        if partition.request:
            yield fetch(partition.request, self.timeout)


class ListingPages(DataSource):
    """spark.read.format("listing_pages").option("requests", json list of {source, mirror_rank, url, json, headers})."""

    @classmethod
    def name(cls):
        return "listing_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def fetch_pages(spark: SparkSession, requests: list[dict], timeout: float = TIMEOUT_S) -> DataFrame:
    prune_sources(spark, ListingPages)
    return spark.read.format("listing_pages").option("requests", json.dumps(requests)).option("timeout", str(timeout)).load()
