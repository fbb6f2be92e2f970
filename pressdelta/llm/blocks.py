"""Comparing the members of large buckets without all pairs of their blocks.

A bucket of s members is cut into blocks of bounded size, and a unit is what one task
compares at once. For components, pairs inside one component need no comparison, so a
large bucket is searched twice:

1. ``first_units``: every block by itself, with some ``PIVOTS`` members of the whole
   bucket added to each. What is alike is in one component after this, in s rows and
   few more, because it is linked to a pivot or to something that is.
2. ``later_units``: given the components so far, members outside the bucket's largest
   component meet all others. Pairs inside the largest one are left out, they are
   linked already. With r members outside, that takes about s * ceil(r / block) + r * s
   / block rows, none if there are none outside.

Together every pair is compared or is linked already; no member is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a large bucket, expected number, that every block of it is compared with.
PIVOTS = 64
#: Buckets over one block that are sent to the members; beyond this number they are joined by a shuffle.
SENT = 50_000

_MARK = F.xxhash64


def bucket_sizes(members: DataFrame) -> DataFrame:
    """(part, value, size) of the buckets that hold a pair: ``members(id, part, value, ..)``."""
    return members.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def first_units(members: DataFrame, sizes: DataFrame, block: int, pivots: int = PIVOTS) -> DataFrame:
    """Members with (own, i, j, root): their block, and the blocks that a pivot joins. No root is known yet."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(_MARK("id"), blocks.cast("long")).cast("int")
    pivot = (blocks > 1) & (F.pmod(_MARK("id", F.lit(1)), F.ceil(F.col("size") / pivots).cast("long")) == 0)
    place = F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))
    rows = members.join(sizes, ["part", "value"]).select(*members.columns, own.alias("own"), place.alias("i"))
    return rows.withColumn("j", F.col("i")).withColumn("root", F.col("id"))


def large_buckets(sizes: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Buckets over one block, and their number: at most one for each ``block`` members."""
    large = sizes.where(F.col("size") > block).select("part", "value")
    return large, large.count()


def later_units(members: DataFrame, sizes: DataFrame, known: DataFrame, block: int, sent: int = SENT) -> DataFrame | None:
    """Members of buckets over one block that several components share, as ``first_units``.

    None if there is no bucket of that size.

    ``known(node, root)`` are the components so far. Blocks of the bucket's largest
    component are numbered from 0 up, those of all other members from -1 down.
    """
    large, number = large_buckets(sizes, block)
    if not number:
        return None
    rows = members.join(F.broadcast(large) if number <= sent else large, ["part", "value"]).join(known.select(F.col("node").alias("id"), "root"), "id", "left")
    rows = rows.select(*members.columns, F.coalesce("root", "id").alias("root"))
    shares = rows.groupBy("part", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("part", "value").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("size"))
    mixed = mixed.select("part", "value", F.col("main.root").alias("main"), F.col("main.n").alias("inside"), (F.col("size") - F.col("main.n")).alias("outside"))
    inside, outside = (F.ceil(F.col(c) / block).cast("int") for c in ("inside", "outside"))
    main = F.col("root") == F.col("main")
    own = F.when(main, F.pmod(_MARK("id"), inside.cast("long"))).otherwise(-1 - F.pmod(_MARK("id"), outside.cast("long"))).cast("int")
    other = F.explode(F.sequence(-outside, F.when(main, -1).otherwise(inside - 1)))
    rows = rows.join(mixed.where("outside > 0"), ["part", "value"]).select(*members.columns, "root", own.alias("own"), other.alias("other"))
    # a sequence from -outside to inside - 1 covers both kinds of blocks
    return rows.select(*members.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root")
