"""The revision log as a stream: state per url, micro-batches, idempotent writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.settled import shared_folder

OUTPUT = "url string, seq long, fetched_at timestamp, content_hash string"


def revision_stream(fetches: DataFrame) -> DataFrame:
    """Fetches whose hash differs from the last one of their url.

    ``fetches(url, seq, fetched_at, content_hash)``, streaming. State is one hash a url
    and the sequence number it was seen at, so a delivery repeated in a later
    micro-batch adds nothing and late rows never rewrite the log.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (-1, "")
        rows = pd.concat(list(frames)).sort_values(["fetched_at", "seq"], kind="stable")
        keep = []
        for seq, digest in zip(rows["seq"], rows["content_hash"], strict=True):
            fresh = seq > seen
            keep.append(fresh and digest != last)
            if fresh:
                seen, last = int(seq), digest
        state.update((seen, last))
        yield rows.loc[keep, ["url", "seq", "fetched_at", "content_hash"]]

    return fetches.select("url", "seq", "fetched_at", "content_hash").groupBy("url").applyInPandasWithState(step, OUTPUT, "seq long, content_hash string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process what is there in micro-batches and stop: one scheduled poll."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").foreachBatch(handle).start()
    query.awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a batch has a folder of its own, so a retry replaces it."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    place = shared_folder(spark, name)
    run_available(stream, f"{place}/progress", append_once(f"{place}/rows"))
    return spark.read.schema(stream.schema).parquet(f"{place}/rows/*")
