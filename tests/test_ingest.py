"""Polling, provider answers and evidence with functions in place of the network."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressdelta.operators import analysis as AN
from pressdelta.operators import ingest as IN
from pressdelta.sources import fetch as FE
from pressdelta.sources.fetch import Response

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

FEED = b"<urlset><url><loc>https://n.test/a</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://n.test/b</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://n.test/gone</loc></url></urlset>"
SITES = {
    "https://n.test/map.xml": ("application/xml", FEED),
    "https://n.test/bad.xml": ("application/xml", b"<not"),
    "https://n.test/a": ("text/html", b"<article><p>First text</p></article>"),
    "https://n.test/b": ("text/html", b"<article><p>Second text</p></article>"),
    "https://n.test/image": ("image/png", b"x"),
}


def get(url):
    if url == "https://n.test/slow":
        raise TimeoutError
    if url == "https://down.test/":
        raise OSError("refused; token=abc")
    kind, body = SITES.get(url, (None, b""))
    return Response(200 if kind else 404, url, kind, body)


KNOWN = "url string, content_hash string, marker string"


def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def polled(spark, latest=()):
    sources = spark.createDataFrame([(1, "https://n.test/map.xml", True), (2, "https://n.test/bad.xml", True), (3, "https://down.test/", True), (4, "https://off.test/", False)], "id long, feed_url string, enabled boolean")
    return IN.poll(sources, spark.createDataFrame(list(latest), KNOWN), get, now())


def test_poll_isolates_failures_and_repeats_nothing(spark):
    first = polled(spark)
    assert {(r.url, r.text) for r in first.revisions.collect()} == {("https://n.test/a", "First text"), ("https://n.test/b", "Second text")}
    checks = {r.source_id: r for r in first.checks.collect()}
    assert [(checks[i].status, checks[i].candidates_seen, checks[i].revisions_created, checks[i].failures) for i in (1, 2, 3)] == [("failed", 3, 2, 1), ("failed", 0, 0, 1), ("failed", 0, 0, 1)]
    assert checks[1].error == "article http_error" and "parsed" in checks[2].error and "abc" not in checks[3].error
    s = first.summary.first()
    assert (s.sources_checked, s.candidates_seen, s.revisions_created, s.failures) == (3, 3, 2, 3)
    state = first.articles.join(first.revisions.select("url", "content_hash"), "url").select("url", "content_hash", "marker").collect()
    again = polled(spark, [tuple(r) for r in state])
    assert again.revisions.count() == 0 and {r.url for r in again.articles.collect()} == {"https://n.test/gone"}
    old = [(r.url, r.content_hash, "lastmod:older") for r in state]
    same = polled(spark, old)
    assert same.revisions.count() == 0 and {r.marker for r in same.articles.where("url LIKE '%/a'").collect()} == {"lastmod:2024-01-02"}


def test_poll_of_nothing(spark):
    none = IN.poll(spark.createDataFrame([], "id long, feed_url string, enabled boolean"), spark.createDataFrame([], KNOWN), get, now())
    assert none.revisions.count() == 0 and none.summary.first().sources_checked == 0


def test_published_times(spark):
    rows = spark.createDataFrame([("2024-01-01T08:00:00+08:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("Mon, 01 Jan 2024 00:00:00 GMT",), (None,)], "t string")
    assert [r[0] for r in rows.select(F.unix_timestamp(IN.published_utc(F.col("t")))).collect()] == [1704067200, 1704067200, None, None, None]


def test_page_statuses(spark):
    urls = spark.createDataFrame([(u,) for u in ("ftp://x", "https://n.test/slow", "https://down.test/", "https://n.test/none", "https://n.test/image", "https://n.test/a", "https://n.test/a")], "url string")
    got = {r.requested: r for r in FE.pages(urls, get).collect()}
    assert [got[u].status for u in ("ftp://x", "https://n.test/slow", "https://down.test/", "https://n.test/none", "https://n.test/image", "https://n.test/a")] == ["invalid_url", "timeout", "retrieval_failed", "http_error", "parse_error", "retrieved"]
    saved = {r.requested: r.status for r in FE.pages(urls, get, lambda u: ("t", "text") if "slow" in u else None).collect()}
    assert saved["https://n.test/slow"] == "retrieved" and saved["https://n.test/none"] == "http_error"
    with pytest.raises(ValueError):
        FE.http_get("https://n.test/", 0)


def revisions(spark):
    return spark.createDataFrame([(i, f"https://m.test/{i}", "T", "alpha beta gamma") for i in range(1, 6)], "revision_id long, url string, title string, text string")


def provider(row):
    n = row["revision_id"]
    claim = {"text": "beta", "start": 6, "end": 10, "kind": "checkable", "materiality": "material"}
    candidate = {"finding_type": "factual_contradiction", "summary": "s", "start": 6, "end": 10, "materiality": "material", "query": "q"}
    if n == 2:
        claim["text"] = "other"
    if n == 4:
        raise RuntimeError("secret")
    if n == 5:
        return "{"
    return json.dumps({"revision_id": n, "claims": [claim] * (2 if n == 3 else 1), "candidates": [candidate, {**candidate, "start": 0}]})


def test_answers_are_accepted_whole_or_not(spark):
    answered = AN.answers(revisions(spark), provider)
    claims, candidates, outcomes = AN.accepted(answered, revisions(spark))
    assert {r.revision_id for r in claims.collect()} == {1} and [r.candidate_id for r in candidates.collect()] == ["1-0"]
    assert {r.revision_id: (r.status, r.error) for r in outcomes.collect()} == {
        1: ("completed", None), 2: ("failed", "invalid claim"), 3: ("failed", "duplicate claim span"), 4: ("failed", "RuntimeError"), 5: ("failed", "malformed answer"),
    }


def test_evidence_is_full_text(spark):
    wanted = spark.createDataFrame([(1, 1, "what happened", "s"), (2, 1, "token: abc", "s"), (3, 1, "boom", "s")], "candidate_id long, revision_id long, query string, summary string")

    def search(query, limit):
        if query == "boom":
            raise OSError
        assert query == "what happened" and limit == 5
        return [("https://n.test/a", "snippet", "s", None), ("https://n.test/a#x", "again", "s", None), ("https://n.test/none", "lost", "s", None)]

    got = {r.url: r for r in AN.retrieve(wanted, revisions(spark), search, get).collect()}
    assert set(got) == {"https://n.test/a", "https://n.test/none"} and {r.candidate_id for r in got.values()} == {1}
    assert (got["https://n.test/a"].excerpt, got["https://n.test/a"].status) == ("First text", "retrieved")
    assert (got["https://n.test/none"].excerpt, got["https://n.test/none"].status, got["https://n.test/none"].content_hash) == ("", "retrieval_failed", None)
    assert AN.retrieve(wanted, revisions(spark), AN.no_search, get).count() == 0


def test_safe_metadata(spark):
    rows = spark.createDataFrame([("Daily",), ("token=x",), ("x" * 201,), (None,), ("Bearer abc",)], "v string")
    assert [r[0] for r in rows.select(AN.safe_metadata(F.col("v"))).collect()] == ["Daily", "", "", "", ""]
