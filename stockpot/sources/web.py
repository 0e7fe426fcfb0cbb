"""Fetching pages: a pluggable fetcher over Arrow batches, or a join with a table of pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import urljoin
from ..shipping import ship

MAX_BYTES, MAX_TEXT_BYTES, TIMEOUT_S, TEXT_TIMEOUT_S, MAX_REDIRECTS = 2_000_000, 8_000_000, 20, 45, 8


@dataclass
class Response:
    status: int
    body: str
    location: str | None = None


Get = Callable[[str], Response | None]


def fetch_page(get: Get, url: str, max_bytes: int = MAX_BYTES, max_redirects: int = MAX_REDIRECTS) -> tuple[str, int, str] | None:
    """(final url, status, html): redirects are followed, a body over the limit or too many redirects give None,
    a status outside 200-299 an empty body."""
    for _ in range(max_redirects + 1):
        answer = get(url)
        if answer is None:
            return None
        if 300 <= answer.status < 400 and answer.location:
            url = urljoin(url, answer.location)
            continue
        if not 200 <= answer.status < 300:
            return url, answer.status, ""
        return None if len(answer.body.encode()) > max_bytes else (url, answer.status, answer.body)
    return None


def retrying(get: Get, tries: int = 3, wait: float = 1.0) -> Get:
    """A fetcher that asks again after `wait` seconds, doubled each time, while there is no answer at all."""

    def again(url: str) -> Response | None:
        for i in range(tries):
            if (answer := get(url)) is not None or i == tries - 1:
                return answer
            time.sleep(wait * 2**i)
        return None

    return again


def fetch_text(url: str, get: Get | None = None) -> str | None:
    """The body of a text file such as robots.txt or a sitemap, up to MAX_TEXT_BYTES and within TEXT_TIMEOUT_S; None on failure."""
    got = fetch_page(get or urllib_get(timeout=TEXT_TIMEOUT_S), url, MAX_TEXT_BYTES)
    return got[2] if got and 200 <= got[1] < 300 else None


def urllib_get(timeout: float = TIMEOUT_S, agent: str = "stockpot", most: int = MAX_TEXT_BYTES) -> Get:
    """A fetcher on the standard library, for sessions with a network."""
    from urllib import error, request

    class Stay(request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    def get(url: str) -> Response | None:
        try:
            with request.build_opener(Stay).open(request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return Response(answer.status, answer.read(most + 1).decode("utf-8", "replace"))
        except error.HTTPError as e:
            return Response(e.code, "", e.headers.get("Location"))
        except OSError:
            return None

    return get


def fetcher(make: Callable[[], Get], max_bytes: int = MAX_BYTES) -> Callable[[DataFrame], DataFrame]:
    """A fetch step for crawls: adds final_url, status and html with one `make()` a task."""
    kind = pa.struct([("final_url", pa.string()), ("status", pa.int32()), ("html", pa.string())])

    def run(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = make()
        for batch in urls:
            got = (fetch_page(get, u, max_bytes) if u else None for u in batch.to_pylist())
            yield pa.array([dict(zip(("final_url", "status", "html"), g, strict=True)) if g else None for g in got], kind)

    step = F.arrow_udf(run, "final_url string, status int, html string")
    def fetch(rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        return rows.withColumn("_got", step("url")).withColumns({c: F.col(f"_got.{c}") for c in ("final_url", "status", "html")}).drop("_got")

    return fetch


def from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch step that finds pages in a table (url, html): the web of a machine without a network."""
    known = pages.select("url", "html").dropDuplicates(["url"])
    return lambda rows: rows.join(known, "url").withColumns({"final_url": F.col("url"), "status": F.lit(200)})
