"""Exact deduplication by distributed most-significant-digit radix partitioning.

Every group starts as the whole table. A round splits each group by the next
digit, a run of successive bytes, and numbers the new groups in a written table, so
two documents share a number exactly while all bytes read so far agree. Groups that
became singletons, and documents that have ended, leave the recursion; equality is
decided by the bytes alone and no digest takes part.

The first digit is narrow, later ones widen, so most documents leave after one round
and a text of n bytes needs about log(n) rounds. Digits are counted with partial
aggregation, so thousands of copies reach the shuffle as one row a task. The join that
hands numbers back is salted: texts are dealt over ``SALT`` parts of their group, whose
small row is repeated for each, and adaptive execution may split further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, discard, keep_one, materialize, required

#: Bytes of the first digit, growth of the width, and the widest digit.
FIRST, GROWTH, WIDEST = 48, 12, 1 << 20
#: Parts that the texts of a group are dealt over.
SALT = 4


def normalized(text):
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def exact_dedup(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. A null doc_id is never kept in
    preference to a doc_id; a group of null doc_ids alone has keep_id null and all its
    rows kept. Rows that repeat both doc_id and text all count in group_size and share
    one decision; a doc_id that repeats with other texts is in the group of each. An empty table gives an empty result; other columns are ignored.
    """
    rest = required(docs, "doc_id", "text").select("doc_id", normalized(F.col("text")).alias("text"))
    rest = rest.select("doc_id", F.encode("text", "UTF-8").alias("rest"))
    rest = rest.select(F.lit(0).cast("long").alias("grp"), "doc_id", F.sha2("rest", 256).alias("text_sha256"), "rest")
    width, done, numbers = first, [], []
    while True:
        digit = F.expr(f"substring(rest, 1, {width})")
        salt = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(SALT)).cast("int")
        keyed = rest.select("grp", digit.alias("digit"), salt.alias("salt"), "doc_id", "text_sha256", F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # A digit shorter than the width is the end of the text: its group is final.
        groups = (
            rest.select("grp", "doc_id", digit.alias("digit"))
            .groupBy("grp", "digit")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .withColumn("final", (F.col("group_size") == 1) | (F.length("digit") < width))
        )
        numbers.append(materialize(groups.withColumn("next", F.monotonically_increasing_id()), "groups"))
        salted = numbers[-1].withColumn("salt", F.explode(F.lit(list(range(SALT))).cast("array<int>")))
        split = materialize(
            keyed.join(salted, ["grp", "digit", "salt"]).select(
                F.col("next").alias("grp"), "doc_id", "text_sha256", "keep_id", "group_size", "final",
                F.when(~F.col("final"), F.col("rest")).alias("rest"),
            ),
            "radix",
        )
        done.append(split.where("final").select("doc_id", "keep_id", "group_size", "text_sha256"))
        rest = split.where(~F.col("final")).select("grp", "doc_id", "text_sha256", "rest")
        if rest.isEmpty():
            break
        width = min(width * growth, widest)
    discard(*numbers)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, the one ``exact_dedup`` keeps; all columns.

    Of rows that repeat its doc_id, or that have none, the smallest stays. Null and empty
    texts are one text; an empty table gives an empty result.
    """
    kept = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return keep_one(docs, kept, "doc_id", F.sha2(F.encode(normalized(F.col("text")), "UTF-8"), 256))
