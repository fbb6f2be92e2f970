"""Formats of the store's tables, oldest first, and the step from each to the next.

A step takes the tables by name, as the format before had them, and gives them as the next
one has them. Tables of an older format are read through all steps that are missing; the
steps are projections and joins, so nothing is rewritten until somebody asks for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T

Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

#: Tables as the first format had them; a table that is not named has not changed since.
FIRST = {
    "articles": "url string, source_id long, title string, published_at timestamp, marker string, seq long",
    "revisions": "revision_id long, url string, text string, content_hash string, fetched_at timestamp, seq long",
    "evidence": "finding_id string, url string, title string, excerpt string, relation string, status string, source_kind string",
}


def titled(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Revisions get the title that their article has now."""
    now = tables["articles"].groupBy("url").agg(F.max_by("title", "seq").alias("title"))
    revisions = tables["revisions"].join(now, "url", "left").withColumn("title", F.coalesce("title", F.lit("")))
    return tables | {"revisions": revisions}


def normalized(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Titles and texts of revisions in normal form, and the hash of that."""
    rows = tables["revisions"].withColumns({c: T.normalize(F.col(c)) for c in ("title", "text")})
    return tables | {"revisions": rows.withColumn("content_hash", T.content_hash(F.col("title"), F.col("text")))}


def current(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Articles know their current revision: the one with the largest number."""
    last = tables["revisions"].groupBy("url").agg(F.max("revision_id").alias("current_revision_id"))
    return tables | {"articles": tables["articles"].join(last, "url", "left")}


def sourced(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Evidence tells when and by whom it was found, which older evidence does not know."""
    kinds = {"provider": "string", "published_at": "string", "retrieved_at": "timestamp", "content_hash": "string"}
    return tables | {"evidence": tables["evidence"].withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})}


#: Step k leads from format k + 1 to format k + 2.
STEPS: list[Step] = [titled, normalized, current, sourced]
NEWEST = len(STEPS) + 1


def schemas(newest: dict[str, str], format_: int) -> dict[str, str]:
    """What the tables of a format have in their files."""
    out = dict(newest)
    if format_ >= NEWEST:
        return out
    out |= FIRST
    if format_ >= 2:
        out["revisions"] += ", title string"
    if format_ >= 4:
        out["articles"] += ", current_revision_id long"
    return out


def upgraded(tables: dict[str, DataFrame], format_: int) -> dict[str, DataFrame]:
    """Tables of a format as the newest has them."""
    for step in STEPS[format_ - 1 :]:
        tables = step(tables)
    return tables
