"""Analysis of pending revisions as they arrive: each is saved complete exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as AN
from ..operators import revisions as RV
from ..operators.settled import settle
from ..sources import fetch as FE
from ..store import Store

COLUMNS = ("revision_id", "url", "title", "text", "content_hash", "fetched_at")


def analysis_queue(store: Store, provider: AN.Provider, search: AN.Search, get: FE.Get, fallback: FE.Fallback | None = None, limit: int | None = None, writer: str = "analysis") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that keeps new revisions and analyses all that are pending.

    ``(revision_id, url, title, text, content_hash, fetched_at)`` a row. Pending is what has
    no completion marker, old or new, so an answer that was refused is asked for again with
    a later batch, and ``limit`` puts the rest off. New revisions, findings and markers are one
    commit under the batch's number: a batch that was killed before it leaves nothing, one that is
    repeated after it does nothing, and a revision that comes again is not new.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if store.tables.applied(writer) >= number:
            return
        known = store.log("revisions")
        fresh = batch.select(*COLUMNS).dropDuplicates(["revision_id"]).join(known.select("revision_id"), "revision_id", "left_anti")
        fresh = settle(fresh, "fresh")
        rows = known.select(*COLUMNS).unionByName(fresh.select(*COLUMNS)).withColumn("fetched_epoch", F.unix_timestamp("fetched_at")).drop("content_hash", "fetched_at")
        found = AN.run_pending(rows, store.done(), provider, search, get, fallback, limit=limit)
        seq = (store.log("revisions").agg(F.max("seq")).first()[0] or 0) + 1
        AN.save(found, rows, store.tables, once=(writer, number), more={"revisions": RV.numbered(fresh, seq)})

    return handle
