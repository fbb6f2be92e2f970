"""The state of every article as a stream: what to fetch, and what is a new revision."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "url string, seq long, fetched_at timestamp, marker string, content_hash string"
DECIDED = "url string, seq long, fetched_at timestamp, marker string, content_hash string, decision string"
STATE = "seq long, content_hash string, marker string"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(known: tuple, rows: pd.DataFrame) -> tuple[tuple, list[str | None]]:
    """The state after the rows of one address, in order of ``seq``, and a decision for each.

    A row without a hash is a sighting: ``skip`` if the article is known and its marker is
    the one stored, else ``fetch``. A row with one was read: ``revision`` if the hash is
    not the last one, else ``unchanged``; only then is its marker stored. None is a row that
    was delivered before.
    """
    seen, digest, stored = known
    out: list[str | None] = []
    for seq, marker, now in zip(rows["seq"], rows["marker"], rows["content_hash"], strict=True):
        marker, now = (None if pd.isna(x) else x for x in (marker, now))
        if seq <= seen:
            out.append(None)
            continue
        seen = int(seq)
        if now is None:
            out.append("skip" if digest is not None and marker is not None and marker == stored else "fetch")
        else:
            out.append("unchanged" if now == digest else "revision")
            digest, stored = now, marker if marker is not None else stored
    return (seen, digest, stored), out


class Articles(StatefulProcessor):
    """One value an address: the last number seen, the hash and the marker."""

    def __init__(self, expires: timedelta | None = None):
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.expires is None else int(self.expires.total_seconds() * 1000)
        self.article = handle.getValueState("article", STATE, ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known, decisions = decide(self.article.get() or (-1, None, None) if self.article.exists() else (-1, None, None), whole)
        self.article.update(known)
        whole = whole.assign(decision=decisions)
        yield whole[whole["decision"].notna()][["url", "seq", "fetched_at", "marker", "content_hash", "decision"]]

    def close(self) -> None:
        pass


def article_stream(events: DataFrame, expires: timedelta | None = None) -> DataFrame:
    """``events(url, seq, fetched_at, marker, content_hash)`` with what is to be done about each.

    A stream of both sightings (no hash) and articles that were read. State is one row an
    address in RocksDB, which the session must name as its state store (``use_rocksdb``), so
    it may be larger than memory; with ``expires`` an address that was not seen for that
    long is forgotten, its next reading counts as new, and the session's streams run no
    batches without data. Rows come in micro-batches; inside
    one they are taken in order of ``seq``, and numbers up to the last one seen are repeats.
    """
    mode = "None" if expires is None else "ProcessingTime"
    if expires is not None:  # else a run over what is available makes empty batches for ever
        events.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    keyed = events.select("url", "seq", "fetched_at", "marker", "content_hash").groupBy("url")
    return keyed.transformWithStateInPandas(Articles(expires), DECIDED, "append", mode)


def use_rocksdb(spark) -> None:
    """Keep the state of this session's streams in RocksDB."""
    spark.conf.set(PROVIDER, ROCKS)


@contextmanager
def rocksdb(spark) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, later ones where it was kept before."""
    before = spark.conf.get(PROVIDER, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
