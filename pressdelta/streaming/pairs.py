"""Pairs of revisions of two streams: interval joins with an equality key and bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..operators import topics as TP


def _sides(left: DataFrame, right: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both streams with a bucket, and the condition that a pair is near and in one bucket.

    A right row stands in three buckets, so it meets every left row that is near in exactly
    one. Each side's watermark and the interval tell Spark when a row can meet nothing more.
    """
    bucket = F.floor(F.unix_timestamp("fetched_at") / seconds)
    l = left.withColumn("bucket", bucket).alias("l")  # noqa: E741
    r = right.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("r")
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col("r.fetched_at") >= F.col("l.fetched_at") - span) & (F.col("r.fetched_at") <= F.col("l.fetched_at") + span)
    return l, r, near & (F.col("l.bucket") == F.col("r.bucket"))


def window_pairs_stream(left: DataFrame, right: DataFrame, seconds: int = V.WINDOW_SECONDS, delay: str = "1 hour", ordered: bool = True) -> DataFrame:
    """(left_id, right_id) of revisions at most ``seconds`` apart, as ``topics.window_pairs``.

    ``(revision_id, fetched_at)`` each, streaming. Rows later than ``delay`` behind the
    newest are dropped, and state holds only rows that a row to come may still be near.
    """
    l, r, near = _sides(*[s.select("revision_id", "fetched_at").withWatermark("fetched_at", delay) for s in (left, right)], seconds)  # noqa: E741
    apart = F.col("l.revision_id") < F.col("r.revision_id") if ordered else F.col("l.revision_id") != F.col("r.revision_id")
    return l.join(r, near & apart).select(F.col("l.revision_id").alias("left_id"), F.col("r.revision_id").alias("right_id"))


def high_pairs_stream(left: DataFrame, right: DataFrame, seconds: int = V.WINDOW_SECONDS, delay: str = "1 hour", ordered: bool = True) -> DataFrame:
    """(left_id, right_id, confidence, label) of high pairs, as ``topics.pairs(.., "high")``.

    ``(revision_id, url, title, text, fetched_at)`` each, streaming. Rows meet on bucket and
    named entity; of a pair that shares several the first one counts, so it comes once.
    """

    def named(stream: DataFrame) -> DataFrame:
        rows = stream.withWatermark("fetched_at", delay).withColumn("fetched_epoch", F.unix_timestamp("fetched_at"))
        return TP.features(rows, "fetched_at").withColumn("word", F.explode("named"))

    l, r, near = _sides(named(left), named(right), seconds)  # noqa: E741
    apart = F.col("l.revision_id") < F.col("r.revision_id") if ordered else F.col("l.revision_id") != F.col("r.revision_id")
    met = l.join(r, near & apart & (F.col("l.word") == F.col("r.word"))).where(F.element_at(F.array_intersect("l.named", "r.named"), 1) == F.col("l.word"))
    return met.where(TP.high()).select(F.col("l.revision_id").alias("left_id"), F.col("r.revision_id").alias("right_id"), F.lit("high").alias("confidence"), TP.label().alias("label"))
