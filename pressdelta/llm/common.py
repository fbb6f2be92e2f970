"""Shared helpers: scratch tables, schema guards and null handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this package: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"

_live: set[tuple[SparkSession, str]] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made
    only where that is unset and the master is plain local mode, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        root = "file://" + tempfile.mkdtemp(prefix="pressdelta-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pressdelta/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _live.add((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _live.discard((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in list(_live):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def required(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so columns with clashing names in the input cannot matter."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def keep_one(docs: DataFrame, kept: DataFrame, doc_id: str, key) -> DataFrame:
    """One row of ``docs`` for each row of ``kept(_id, _key, n)``; all columns.

    ``n`` counts the rows of ``docs`` with that doc_id and ``key``. Of rows that repeat
    the smallest stays, compared column by column in the order of ``docs``. Rows travel
    as one struct, so columns of any name may stand in ``docs``.
    """
    kept = materialize(kept, "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), key.alias("key"))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    if kept.where("n > 1").isEmpty():
        return rows.join(kept, on, "left_semi").select("row.*")
    single = rows.join(kept.where("n = 1"), on, "left_semi").select("row.*")
    again = rows.join(kept.where("n > 1"), on).groupBy("_id", "_key").agg(F.min("row").alias("row")).select("row.*")
    return single.unionByName(again)
