"""Live payloads over HTTP as a Spark data source: one partition a chunk of requests or one walk over pages, retries, a double gate."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "endpoint string, url string, status int, body string, attempts int"
WALK_SCHEMA = f"{SCHEMA}, page int, ended string"


class LiveAccessDisabled(RuntimeError):
    pass


def fetch(url: str, attempts: int = 5, delay: float = 0.0, opener=urllib.request.urlopen, sleep=time.sleep) -> tuple[int, str | None, int]:
    """(status, body, attempts used); 429 and 5xx are tried again after a growing pause of at most five seconds."""
    for n in range(1, attempts + 1):
        if delay:
            sleep(delay)
        try:
            with opener(url) as r:
                return r.status, r.read().decode("utf-8", "replace"), n
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or n == attempts:
                return e.code, None, n
        except OSError:
            if n == attempts:
                raise
        sleep(min(5.0, 0.5 * 2 ** (n - 1)))
    return 0, None, attempts


def page_url(url: str, page: int, name: str = "pageNumber") -> str:
    """The URL with that page number, whatever number it had."""
    parts = urllib.parse.urlsplit(url)
    query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k != name]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode([*query, (name, page)])))


def pagination(body: str | None) -> dict | None:
    """What a payload says about its pages (meta.pagination), if it is an object that says so."""
    try:
        meta = json.loads(body or "").get("meta")
        found = meta.get("pagination")
    except (ValueError, AttributeError):
        return None
    return found if isinstance(found, dict) else None


def walk(endpoint: str, url: str, delay: float = 0.0, opener=urllib.request.urlopen, sleep=time.sleep, first: int = 0) -> Iterator[tuple]:
    """The pages of an endpoint, each as it comes: (endpoint, url, status, body, attempts, page, ended).

    The walk goes on while a page names a next one or the counts have not reached the total; `ended` says on the last page why it stops:
    complete; no_pagination (a payload that tells nothing of pages, or no JSON); missing (an error status after the first page, whose row
    is not given); failed (an error status on the first one); repeats (the server sent the page before once more, so it knows no such page;
    that row is not given either).  Each page is held until the next one is known."""
    held: list | None = None
    taken, page = 0, first
    while True:
        at = page_url(url, page)
        status, body, n = fetch(at, delay=delay, opener=opener, sleep=sleep)
        if status >= 400 or body is None:
            if held:
                yield *held, "missing"
            else:
                yield endpoint, at, status, body, n, page, "failed"
            return
        if held:
            if body == held[3]:
                yield *held, "repeats"
                return
            yield *held, None
        held = [endpoint, at, status, body, n, page]
        told = pagination(body)
        if told is None:
            yield *held, "no_pagination"
            return
        taken += int(told.get("count") or 0)
        if not told.get("nextUrl") and taken >= int(told.get("total") or 0):
            yield *held, "complete"
            return
        page += 1


@dataclass
class Requests(InputPartition):
    urls: list


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        if options.get("live") != "true" or options.get("allowNetwork") != "true":
            raise LiveAccessDisabled("live requests need both options: live and allowNetwork")
        self.requests = json.loads(options["requests"])  # [[endpoint, url], ...]
        self.walks = options.get("pages") == "follow"
        self.chunk = int(options.get("chunk", 1 if self.walks else 50))
        self.delay = float(options.get("delaySeconds", 0.2))

    def partitions(self) -> list[InputPartition]:
        return [Requests(self.requests[i : i + self.chunk]) for i in range(0, len(self.requests), self.chunk)] or [Requests([])]

    def read(self, partition: Requests) -> Iterator[tuple]:
        for endpoint, url in partition.urls:
            if self.walks:
                yield from walk(endpoint, url, self.delay)
                continue
            status, body, n = fetch(url, delay=self.delay)
            yield endpoint, url, status, body, n


class HttpSource(DataSource):
    """Options: live and allowNetwork (both "true"), requests (JSON: [[endpoint, url], ...]), chunk, delaySeconds; pages = "follow" walks
    from each URL to its last page, one partition a walk, and adds page and ended."""

    @classmethod
    def name(cls) -> str:
        return "payload_http"

    def schema(self) -> str:
        return WALK_SCHEMA if self.options.get("pages") == "follow" else SCHEMA

    def reader(self, schema) -> HttpReader:
        return HttpReader(self.options)
