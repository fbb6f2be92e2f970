"""Streams of revisions against the batch operators, with restarts and broken batches."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressdelta.operators import revisions as RV
from pressdelta.operators import topics as TP
from pressdelta.sources.fetch import Response
from pressdelta.store import Store
from pressdelta.streaming import articles as SA
from pressdelta.streaming import pairs as SP
from pressdelta.streaming import queue as SQ
from pressdelta.streaming import revisions as S
from pressdelta.tables import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

BASE = 1_700_000_000


def parts(df, path, cuts, column="seq"):
    """Rows of ``df`` as files of a stream, in order of a column."""
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        test = " AND ".join([f"{column} >= {low}"] * (low is not None) + [f"{column} < {high}"] * (high is not None)) or "true"
        df.where(test).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, tmp_path, name):
    """All rows that a stream gives, and the rows that its state holds at the end."""
    query = df.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).outputMode("append").format("parquet").option("path", str(tmp_path / name)).start()
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    return [tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name)).collect()], held


@pytest.fixture
def small_state(spark):
    """State of one partition, so streams start fast."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_window_pairs_of_streams_equal_batch(spark, tmp_path, small_state):
    rows = spark.range(240).select(F.col("id").alias("revision_id"), (F.lit(BASE) + F.col("id") * 9_000 + F.col("id") % 7 * 400).alias("fetched_epoch"))
    stamped = rows.withColumn("fetched_at", F.timestamp_seconds("fetched_epoch")).drop("fetched_epoch")
    path = parts(stamped, str(tmp_path / "in"), range(40, 240, 40), "revision_id")
    got, held = run(SP.window_pairs_stream(stream(spark, path, stamped.schema), stream(spark, path, stamped.schema), 36_000, "2 hours"), tmp_path, "pairs")
    want = TP.window_pairs(rows, rows, 36_000).select("l.revision_id", "r.revision_id").collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and len(got) > 500
    assert max(held) < 4 * 110 < 4 * 240  # a row and its three copies leave once nothing can be near them


def test_high_pairs_of_streams_equal_batch(spark, tmp_path, small_state):
    cities, verbs = ["Taipei", "Tainan", "Yilan"], ["approved", "rejected"]
    data = [(i, f"https://m{i % 3}.test/{i}", f"{cities[i % 3 - 1]} permit", f"{cities[i * 7 % 3]} Council {verbs[i % 2]} the coastal permit after review {i % 5}.", BASE + i * 7_000) for i in range(60)]
    rows = spark.createDataFrame(data, "revision_id long, url string, title string, text string, fetched_epoch long")
    stamped = rows.withColumn("fetched_at", F.timestamp_seconds("fetched_epoch")).drop("fetched_epoch")
    path = parts(stamped, str(tmp_path / "in"), (20, 40), "revision_id")
    got, _ = run(SP.high_pairs_stream(stream(spark, path, stamped.schema), stream(spark, path, stamped.schema)), tmp_path, "high")
    assert sorted(got) == sorted(tuple(r) for r in TP.pairs(rows, "high").collect()) and got


def test_hot_entities_are_dealt_over_parts(spark):
    rows = spark.createDataFrame([(i, f"https://m{i % 3}.test/{i}", "T", f"Taipei Council Yilan{i % 4} spoke.", BASE + i) for i in range(50)], "revision_id long, url string, title string, text string, fetched_epoch long")
    read = TP.features(rows)
    want = sorted(map(tuple, TP.high_candidates(read, read).collect()))
    assert want == sorted(map(tuple, TP.high_candidates(read, read, hot=3).collect())) and len(want) == len(set(want)) == sum(i % 3 != j % 3 for i in range(50) for j in range(i))
    assert len(want) * 2 == TP.high_candidates(read, read, ordered=False, hot=3).count()


# -- articles -----------------------------------------------------------------------


EVENTS = [(f"u{i % 4}", i, (None, "m1", "m2")[i // 5 % 3], None if i % 3 == 0 else f"h{i // 7 % 2}") for i in range(60)]


def events(spark):
    return spark.createDataFrame(EVENTS, "url string, seq long, marker string, content_hash string").withColumn("fetched_at", F.timestamp_seconds(F.col("seq") + BASE)).select("url", "seq", "fetched_at", "marker", "content_hash")


def decided(spark):
    """Decisions by the batch operators alone; every sighting is an address of its own."""
    out, rows = {}, events(spark)
    for r in RV.changes(rows.where("content_hash IS NOT NULL"), "url", "content_hash", ["seq"]).select("url", "seq").collect():
        out[r.seq] = "revision"
    sighted, latest = [], []
    for url, seq, marker, digest in EVENTS:
        if digest is not None:
            out.setdefault(seq, "unchanged")
            continue
        before = [m for u, s, m, h in EVENTS if u == url and s < seq and h is not None]
        sighted.append((str(seq), marker))
        latest += [(str(seq), next((m for m in reversed(before) if m is not None), None))] if before else []
    wanted = RV.to_fetch(spark.createDataFrame(sighted, "url string, marker string"), spark.createDataFrame(latest, "url string, stored_marker string"))
    fetch = {int(r.url) for r in wanted.collect()}
    return out | {int(u): "fetch" if int(u) in fetch else "skip" for u, _ in sighted}


def test_article_states_equal_batch_after_a_restart(spark, tmp_path, small_state):
    SA.use_rocksdb(spark)
    rows, want = events(spark), decided(spark)
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    try:
        parts(rows.where("seq < 30"), path, (15,))
        S.run_available(SA.article_stream(stream(spark, path, rows.schema)), cp, S.append_once(out))
        parts(rows.where("seq >= 25"), path, (45,))  # some of it once more
        S.run_available(SA.article_stream(stream(spark, path, rows.schema)), cp, S.append_once(out))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.seq, r.decision) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want.items()) and {"skip", "fetch", "revision", "unchanged"} == set(want.values())


def test_forgotten_articles_are_new_again(spark, tmp_path, small_state):
    from datetime import timedelta

    SA.use_rocksdb(spark)
    rows = events(spark).where("url = 'u1' AND content_hash = 'h0' AND seq < 14")
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    try:
        for at in (1, 5):
            rows.where(f"seq = {at}").write.mode("append").parquet(path)
            S.run_available(SA.article_stream(stream(spark, path, rows.schema), timedelta(milliseconds=1)), cp, S.append_once(out))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r.seq, r.decision) for r in spark.read.parquet(out).orderBy("seq").collect()] == [(1, "revision"), (5, "revision")]


# -- queue --------------------------------------------------------------------------


def provider(row):
    text, ident = row["text"], int(row["revision_id"])
    if "refuse" in text and len(row["related"] if row["related"] is not None else []) < 2:
        return "{}"
    at = text.index("permit")
    span = {"start": at, "end": at + 6, "materiality": "material"}
    return json.dumps({"revision_id": ident, "claims": [{"text": "permit", "kind": "checkable", **span}], "candidates": []})


def test_each_revision_is_analysed_once(spark, tmp_path, small_state, monkeypatch):
    data = [(i, f"https://m{i % 2}.test/{i}", "Taipei permit", f"Taipei Council {('approved', 'rejected')[i % 2]} the coastal permit {'refuse' if i in (2,) else ''} review.", f"h{i}", BASE + i) for i in range(6)]
    rows = spark.createDataFrame(data, "revision_id long, url string, title string, text string, content_hash string, t long").withColumn("fetched_at", F.timestamp_seconds("t")).drop("t")
    path = parts(rows, str(tmp_path / "in"), (3,), "revision_id")
    parts(rows.where("revision_id = 1"), path, (), "revision_id")  # delivered once more
    store = Store(spark, str(tmp_path / "store"))
    get = lambda url: Response(404, url, None, b"")
    handle = SQ.analysis_queue(store, provider, lambda query, limit: (), get)
    publish, calls = Tables._publish, []

    def broken(self, entry):
        calls.append(entry["version"])
        if len(calls) == 2:
            raise OSError("killed between the tables and the log")
        return publish(self, entry)

    monkeypatch.setattr(Tables, "_publish", broken)
    read = stream(spark, path, rows.schema)
    with pytest.raises(Exception, match="killed"):
        S.run_available(read, str(tmp_path / "cp"), handle)
    before = store.tables.snapshot()["version"]
    S.run_available(read, str(tmp_path / "cp"), handle)
    handle(rows.limit(2), 0)  # a batch that was committed but not marked in the checkpoint
    assert before == 1 and store.tables.snapshot()["version"] == 3 and store.tables.applied("analysis") == 2
    assert sorted(r.revision_id for r in store.log("revisions").collect()) == list(range(6))
    done = sorted(r.revision_id for r in store.log("outcomes").where("status = 'completed'").collect())
    claims = sorted(r.revision_id for r in store.log("claims").collect())
    assert done == claims == sorted(set(done)) == [0, 1, 2, 3, 4, 5]
    found = [tuple(r) for r in store.log("findings").select("revision_id", "peer_id").collect()]
    assert len(found) == len(set(found)) and found
