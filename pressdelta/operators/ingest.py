"""One poll of all sources as joins and aggregates: candidates, fetches, new revisions, checks.

Responses are settled before they are used twice, so no address is fetched again and a
lost executor does not change what was seen. Decisions: an address listed more than once
in a run is one candidate, the last by source and position; its marker is stored only
when the article was read; published times with a zone are kept in UTC, others are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import redact as R
from ..functions import text as T
from ..sources import fetch as FE
from ..sources import markup as M
from . import revisions as RV
from .settled import settle


@dataclass(frozen=True)
class Poll:
    """Tables to append or upsert after a poll."""

    articles: DataFrame  # url, source_id, title, published_at, marker
    revisions: DataFrame  # url, title, text, content_hash, fetched_at
    checks: DataFrame  # source_id, checked_at, status, candidates_seen, revisions_created, failures, error
    summary: DataFrame  # counters of the run, one row


def published_utc(value: Column) -> Column:
    """The instant of an ISO time that names its zone; null for all other text."""
    aware = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.try_to_timestamp(value))


def lenient_utc(value: Column) -> Column:
    """The instant of an ISO time; one without a zone is UTC, all other text is null."""
    text = F.regexp_replace(F.trim(value), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2}|)$", "$1:00$2")
    known = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?"
    zoned, naive = text.rlike(known + r"(?:Z|[+-]\d{2}:?\d{2})$"), text.rlike(known + "$")
    return F.when(zoned, F.try_to_timestamp(text)).when(naive, F.try_to_timestamp(F.concat(text, F.lit("Z"))))


def poll(sources: DataFrame, latest: DataFrame, get: FE.Get, started_at: Column) -> Poll:
    """Fetch enabled ``sources(id, feed_url, enabled)`` and what is new on them.

    ``latest(url, content_hash, marker)`` is the current state of known articles. A failing
    source or article is an error of its source's check and stops nothing else.
    """
    enabled = sources.where("enabled").select(F.col("id").alias("source_id"), "feed_url")
    feeds = settle(FE.responses(enabled, get, "feed_url"))
    read = feeds.where("error IS NULL")
    found = M.candidates(read.dropDuplicates(["url"]).select("url", "content_type", "body"), limit=V.MAX_CANDIDATES)
    listed = settle(enabled.join(feeds.select(F.col("requested").alias("feed_url"), F.col("url").alias("source_url")), "feed_url").join(found, "source_url"))
    marker = RV.change_marker(F.lit(None).cast("string"), F.col("lastmod"))
    last = F.max_by(F.struct("source_id", "title", "published_at", marker.alias("marker")), F.struct("source_id", "pos"))
    wanted = RV.to_fetch(listed.groupBy("url").agg(last.alias("c")).select("url", "c.*"), latest.select("url", F.col("marker").alias("stored_marker")))
    got = FE.pages(wanted, get, limit=None).select(F.col("requested").alias("url"), T.normalize(F.col("text")).alias("text"), "status")
    known = latest.select("url", F.col("content_hash").alias("known_hash"), F.col("marker").alias("known_marker"))
    done = wanted.join(got, "url").join(known, "url", "left").withColumn("title", T.normalize(F.col("title")))
    ok = F.col("status") == "retrieved"
    digest = F.when(ok, T.content_hash(F.col("title"), F.col("text")))
    done = settle(done.withColumn("content_hash", digest).withColumn("created", ok & ~F.col("content_hash").eqNullSafe(F.col("known_hash"))))

    articles = done.select("url", "source_id", "title", published_utc(F.col("published_at")).alias("published_at"), F.when(ok, F.coalesce("marker", "known_marker")).otherwise(F.col("known_marker")).alias("marker"))
    revisions = done.where("created").select("url", "title", "text", "content_hash", started_at.alias("fetched_at"))

    seen = listed.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    outcome = done.groupBy("source_id").agg(
        F.count_if("created").alias("created"), F.count_if(~ok).alias("failed"),
        F.max(F.when(~ok, F.concat(F.lit("article "), "status"))).alias("article_error"),
    )
    unread = M.is_xml(F.col("content_type"), F.col("url")) & (F.length(F.trim(F.decode("body", "ISO-8859-1"))) > 0)
    state = enabled.join(feeds.select(F.col("requested").alias("feed_url"), "error", F.coalesce(unread, F.lit(False)).alias("unread")), "feed_url", "left")
    state = state.join(seen, "source_id", "left").join(outcome, "source_id", "left")
    n = F.coalesce("n", F.lit(0))
    source_error = F.coalesce("error", F.when(F.col("feed_url").isNull(), "source has no address"), F.when(F.col("unread") & (n == 0), "source feed could not be parsed"))
    failures = F.coalesce("failed", F.lit(0)) + source_error.isNotNull().cast("int")
    checks = state.select(
        "source_id", started_at.alias("checked_at"), F.when(failures > 0, "failed").otherwise("ok").alias("status"), n.alias("candidates_seen"),
        F.coalesce("created", F.lit(0)).alias("revisions_created"), failures.cast("long").alias("failures"), R.safe_error(F.coalesce(source_error, "article_error")).alias("error"),
    )
    summary = checks.agg(
        F.count(F.lit(1)).alias("sources_checked"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates_seen", "revisions_created", "failures")],
    ).withColumn("started_at", started_at)
    return Poll(articles, revisions, checks, summary)
