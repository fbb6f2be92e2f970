"""The revision log: upserts, appends on change, pending and recent revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V


def upsert(rows: DataFrame, key: str, seq: str, id_name: str = "id") -> DataFrame:
    """The last row of each key with a stable id, the key's first ``seq``; one partial aggregation."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("last")
    return rows.groupBy(key).agg(F.min(seq).alias(id_name), F.max(seq).alias(f"last_{seq}"), last).select(id_name, key, f"last_{seq}", "last.*")


def add_once(sources: DataFrame, new: DataFrame) -> DataFrame:
    """New sources whose feed_url is neither a known feed nor a known article list."""
    known = sources.select(F.col("feed_url").alias("url")).union(sources.select(F.col("article_url").alias("url"))).where("url IS NOT NULL").distinct()
    return new.join(known, new.feed_url == known.url, "left_anti")


def set_enabled(sources: DataFrame, source_id: int, enabled: bool) -> DataFrame:
    return sources.withColumn("enabled", F.when(F.col("id") == source_id, F.lit(enabled)).otherwise(F.col("enabled")))


def changes(fetches: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Fetches whose content differs from the one before of the same key: the revisions."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    return fetches.withColumn("_before", before).where(~F.col(content).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def change_marker(etag: Column, lastmod: Column) -> Column:
    """What tells that a page may have changed: its etag, else its sitemap date, else null."""
    return F.coalesce(
        F.when(F.coalesce(etag, F.lit("")) != "", F.concat(F.lit("article_etag:"), etag)),
        F.when(F.coalesce(lastmod, F.lit("")) != "", F.concat(F.lit("lastmod:"), lastmod)),
    )


def with_articles(revisions: DataFrame, articles: DataFrame) -> DataFrame:
    """Revisions with what is known of their article; one without an article is none."""
    return revisions.join(articles, "article_id")


def to_fetch(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates without a known revision, without a marker or with a new one.

    ``candidates(url, marker, ...)``, ``latest(url, stored_marker)``: one row a url.
    """
    joined = candidates.join(latest.withColumn("_known", F.lit(True)), "url", "left")
    skip = F.col("_known") & F.col("marker").isNotNull() & (F.col("marker") == F.col("stored_marker"))
    return joined.where(~F.coalesce(skip, F.lit(False))).drop("_known", "stored_marker")


def pending(revisions: DataFrame, done: DataFrame, limit: int | None = V.PENDING_LIMIT) -> DataFrame:
    """Revisions without a completion marker, by id; the limit is the feature."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    rest = revisions.join(done.select("revision_id"), "revision_id", "left_anti")
    return rest if limit is None else rest.orderBy("revision_id").limit(limit)


def recent(revisions: DataFrame, limit: int = V.CONTEXT_POOL) -> DataFrame:
    """The newest revisions, later id first among equals."""
    return revisions.orderBy(F.desc("fetched_epoch"), F.desc("revision_id")).limit(limit)


def link_topics(links: DataFrame, new: DataFrame) -> DataFrame:
    """Topic links with new ones, each pair once."""
    return links.select("topic_id", "revision_id").unionByName(new.select("topic_id", "revision_id")).dropDuplicates(["topic_id", "revision_id"])


def numbered(rows: DataFrame, seq: int) -> DataFrame:
    """Rows of one write with its number."""
    return rows.withColumn("seq", F.lit(seq).cast("long"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def run_summary(checks: DataFrame) -> DataFrame:
    """Counters of each run over its source checks."""
    return checks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources_checked"), F.sum("candidates_seen").alias("candidates_seen"),
        F.sum("revisions_created").alias("revisions_created"), F.sum("failures").alias("failures"),
    )


def source_health(checks: DataFrame) -> DataFrame:
    """The latest check of every source; failed if any of it failed."""
    latest = F.max_by(F.struct("checked_at", "candidates_seen", "failures", "error"), F.struct("checked_at", "check_id"))
    status = F.when(F.col("last.failures") > 0, "failed").otherwise("ok")
    return checks.groupBy("source_id").agg(latest.alias("last")).select("source_id", status.alias("status"), "last.checked_at", "last.candidates_seen", "last.error")


def metadata_of(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, metadata): what is stored about known addresses, null for unknown ones."""
    return urls.select("url").distinct().join(articles.select("url", "metadata"), "url", "left")


def metadata_map(stored: Column) -> Column:
    """Stored metadata as map<string,string>; null where it is no JSON object of strings."""
    found = F.from_json(stored, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(stored.rlike(r"^\s*\{"), found)


def source_counts(sources: DataFrame) -> DataFrame:
    """(sources, enabled): how many there are, one row."""
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if("enabled").alias("enabled"))
