"""Fetching by an injected function: addresses in, responses, articles or pages out.

``get(url)`` returns ``Response(status, url, content_type, body)`` or raises. It runs on
the executors, batch by batch; a failure becomes a value in its row and never fails the
job. Every address is fetched once a call, however often it is asked for.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from ..functions import urls as U
from .markup import read_article


class Response(NamedTuple):
    status: int
    url: str
    content_type: str | None
    body: bytes


Get = Callable[[str], Response]
#: Another way to a page: (title, text) of an address, or None.
Fallback = Callable[[str], tuple[str, str] | None]


def http_get(url: str, timeout: float = V.MAX_TIMEOUT) -> Response:
    """One GET; an HTTP error is a response, and one byte over the limit tells an oversized body."""
    if timeout <= 0:
        raise ValueError("timeout must be positive")
    try:
        with urllib.request.urlopen(url, timeout=min(timeout, V.MAX_TIMEOUT)) as answer:
            return Response(answer.status, answer.url, answer.headers.get("Content-Type"), answer.read(V.MAX_BYTES + 1))
    except urllib.error.HTTPError as answer:
        return Response(answer.code, url, answer.headers.get("Content-Type"), b"")


def _each(urls: DataFrame, column: str, one: Callable[[str], tuple], schema: str) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(u) for u in batch[column]], columns=names).astype(object)

    asked = urls.select(column).where(F.col(column).isNotNull()).distinct()
    return asked.mapInPandas(run, schema)


RESPONSE = "requested string, url string, content_type string, body binary, error string"


def response(asked: str, get: Get) -> tuple:
    """One row of ``RESPONSE``; whatever goes wrong is its error."""
    try:
        r = get(asked)
    except Exception as e:
        return asked, asked, None, None, str(e) or type(e).__name__
    if not 200 <= r.status < 300:
        return asked, r.url, r.content_type, None, f"source returned HTTP {r.status}"
    if len(r.body) > V.MAX_BYTES:
        return asked, r.url, r.content_type, None, "source is too large"
    return asked, r.url, r.content_type, r.body, None


def responses(urls: DataFrame, get: Get, column: str = "url") -> DataFrame:
    """(requested, url, content_type, body, error); error is null for a usable 2xx response."""
    return _each(urls, column, lambda asked: response(asked, get), RESPONSE)


def pages(urls: DataFrame, get: Get, fallback: Fallback | None = None, column: str = "url", limit: int | None = V.MAX_PAGE_TEXT) -> DataFrame:
    """(requested, url, title, text, status, content_hash): the readable text behind an address.

    Texts are cut at ``limit`` characters, None for whole texts; the hash is of what is kept.

    Status is retrieved, invalid_url, timeout, http_error, oversized, parse_error or
    retrieval_failed. Where the first way fails, ``fallback`` may still retrieve the page.
    """

    def first(asked: str) -> tuple:
        try:
            r = get(asked)
        except TimeoutError:
            return asked, "", "", "timeout"
        except Exception:
            return asked, "", "", "retrieval_failed"
        if not 200 <= r.status < 300:
            return asked, "", "", "http_error"
        if len(r.body) > V.MAX_BYTES:
            return asked, "", "", "oversized"
        title, text = read_article(r.body, r.content_type)
        return (r.url or asked, title, text[:limit], "retrieved") if text else (asked, "", "", "parse_error")

    def one(asked: str) -> tuple:
        if not asked.lower().startswith(("http://", "https://")):
            return asked, asked, "", "", "invalid_url"
        url, title, text, status = first(asked)
        if status != "retrieved" and fallback is not None:
            try:
                other = fallback(asked)
            except Exception:
                other = None
            if other and other[1].strip():
                url, title, text, status = asked, other[0][: V.MAX_TITLE], other[1][:limit], "retrieved"
        return asked, url, title, text, status

    rows = _each(urls, column, one, "requested string, url string, title string, text string, status string")
    got = F.col("status") == "retrieved"
    final = F.when(U.is_http(F.col("url")), F.col("url")).otherwise(F.col("requested"))
    return rows.withColumns({"url": final, "content_hash": F.when(got, T.content_hash(F.col("title"), F.col("text")))})
