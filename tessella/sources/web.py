"""A page source: fetches URLs with a rate limit, retries and back-off. The fetch function is a parameter, so tests and offline runs need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


class NotFound(Exception):
    """The page doesn't exist; no use in trying again."""


def http_get(url: str, timeout: float = 30.0, agent: str = "catalogue-harvest/1.0") -> bytes:
    """The body by HTTP; NotFound where the server says that there is none."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:  # noqa: S310  the caller gives the URLs
            return answer.read()
    except HTTPError as e:
        if e.code in (404, 410):
            raise NotFound(url) from e
        raise


def http_text(url: str) -> str:
    return http_get(url).decode("utf-8", "replace")


@dataclass
class RateLimiter:
    """At least min_interval seconds between calls that share it; see fetch_pages for a limit over all tasks."""

    min_interval: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = field(default=0.0)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + self.min_interval


@dataclass
class Fetcher:
    """get(url): the body, None where the page doesn't exist; other failures are tried again after 1, 2, 4 ... seconds."""

    fetch: Callable[[str], str]
    delay: float = 0.2
    tries: int = 3
    sleep: Callable[[float], None] = time.sleep

    def get(self, url: str, gate: RateLimiter | None = None) -> str | None:
        for k in range(self.tries):
            if gate:
                gate.wait()
            try:
                return self.fetch(url)
            except NotFound:
                return None
            except Exception:  # noqa: BLE001
                if k + 1 == self.tries:
                    raise
                self.sleep(2.0**k)
        return None


def fetch_pages(urls: DataFrame, fetcher: Fetcher, workers: int = 4) -> DataFrame:
    """url to url, html, status (ok, missing, failed).

    One rate for all: the URLs are dealt to `workers` tasks, and each task's gate waits workers times the fetcher's delay between calls, so
    that whichever of them run, no more than one call starts in each delay on average.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = RateLimiter(fetcher.delay * workers)
        for f in frames:
            rows = []
            for url in f["url"]:
                try:
                    html = fetcher.get(url, gate)
                    rows.append((url, html, "ok" if html is not None else "missing"))
                except Exception:  # noqa: BLE001
                    rows.append((url, None, "failed"))
            yield pd.DataFrame(rows, columns=["url", "html", "status"])

    return urls.select("url").repartition(workers).mapInPandas(run, "url string, html string, status string")
