"""The log of commits, formats of the store, and runs that break off at any write."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressdelta import migrations as MG
from pressdelta import store as ST
from pressdelta.functions import text as T
from pressdelta.sources.fetch import Response
from pressdelta.store import Store
from pressdelta.tables import Conflict, Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

SCHEMAS = {"a": "n long", "b": "s string"}


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def held(tables, name="a", version=None):
    return sorted(r[0] for r in tables.read(name, version).collect())


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "t"), SCHEMAS)
    assert held(tables) == [] and tables.versions() == []
    assert tables.commit({"a": numbers(spark, 1), "b": spark.createDataFrame([("x",)], "s string")}) == 1
    assert tables.commit({"a": numbers(spark, 2)}) == 2 and held(tables) == [1, 2] and held(tables, version=1) == [1]
    monkeypatch.setattr(Tables, "_publish", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        tables.commit({"a": numbers(spark, 3)})
    monkeypatch.undo()
    assert held(tables) == [1, 2]
    assert tables.vacuum() == 1 and held(tables) == [1, 2]


def test_writers_take_turns(spark, tmp_path):
    one, two = (Tables(spark, str(tmp_path / "t"), SCHEMAS) for _ in range(2))
    start = one.commit({"a": numbers(spark, 1)})
    publish = one._publish

    def slow(entry):  # another commit gets ahead
        one._publish = publish
        two.commit({"a": numbers(spark, 2)})
        return publish(entry)

    one._publish = slow
    assert one.commit({"a": numbers(spark, 3)}) == 3 and held(two) == [1, 2, 3]
    assert one.commit({"b": spark.createDataFrame([("x",)], "s string")}, since=start) == 4
    with pytest.raises(Conflict):
        one.commit({"a": numbers(spark, 4)}, since=start)
    assert held(two) == [1, 2, 3]


def test_numbers_of_a_writer_count_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), SCHEMAS)
    for number in (0, 0, 1, 0, 1):
        tables.commit({"a": numbers(spark, number)}, once=("w", number))
    assert held(tables) == [0, 1] and tables.applied("w") == 1 and tables.applied("v") == -1


def test_compaction(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), SCHEMAS)
    for n in range(5):
        tables.commit({"a": numbers(spark, n)})
    old = tables.snapshot()["tables"]["a"]
    tables.compact("a")
    assert held(tables) == list(range(5)) and len(tables.snapshot()["tables"]["a"]) == 1 and held(tables, version=3) == [0, 1, 2]
    with pytest.raises(Conflict):
        tables.commit({}, replaced={"a": old})
    assert tables.vacuum(keep=1) == 5 and held(tables) == list(range(5)) and tables.versions() == [6]


# -- runs ---------------------------------------------------------------------------


PAGES = {"https://n.test/1": "First", "https://n.test/2": "Second"}


def get(url):
    if url.endswith("map.xml"):
        return Response(200, url, "application/xml", b"<urlset>" + b"".join(f"<url><loc>{u}</loc><lastmod>1</lastmod></url>".encode() for u in PAGES) + b"</urlset>")
    return Response(200, url, "text/html", f"<article><p>{PAGES[url]}</p></article>".encode())


@pytest.mark.parametrize("write", ["revisions", "articles", "checks", "_publish"])
def test_a_broken_run_loses_nothing(spark, tmp_path, monkeypatch, write):
    whole, store = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "broken"))
    for s in (whole, store):
        s.add_source("N", "https://n.test/map.xml", None)
    whole.watch(get)
    real = Tables._write

    def fails(self, name, rows):
        if name == write:
            rows.limit(1).write.parquet(f"{self.path}/{name}/half-written")
            raise OSError("killed")
        return real(self, name, rows)

    if write == "_publish":
        monkeypatch.setattr(Tables, "_publish", lambda self, entry: (_ for _ in ()).throw(OSError("killed")))
    else:
        monkeypatch.setattr(Tables, "_write", fails)
    with pytest.raises(OSError):
        store.watch(get)
    monkeypatch.undo()
    assert store.revisions().count() == 0
    assert store.watch(get)["revisions_created"] == 2 and store.watch(get)["revisions_created"] == 0
    content = lambda s: sorted((r.url, r.text, r.content_hash) for r in s.log("revisions").collect())
    assert content(store) == content(whole) and len(content(store)) == 2
    assert {r.current_revision_id for r in store.articles().collect()} == {r.revision_id for r in store.log("revisions").collect()}


def test_sources_have_one_check_a_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.add_source("N", "https://n.test/map.xml", "https://n.test/list") == 1 and store.add_source("M", "https://n.test/list", None) == 1
    assert store.add_source("M", "https://m.test/map.xml", None) == 2
    store.watch(get), store.watch(get)
    assert sorted((r.check_id, r.source_id) for r in store.checks().collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


# -- formats ------------------------------------------------------------------------


def first_format(spark, path, format_=1):
    """A store as the given format has it: decomposed and CRLF texts, hashes of nothing."""
    tables = Tables(spark, path, MG.schemas(ST.SCHEMAS, format_), format_)
    stamp = "timestamp '2024-01-01 00:00:00'"
    rows = {
        "articles": f"SELECT * FROM VALUES ('u', 1L, 'Old', {stamp}, 'm', 1L), ('u', 1L, 'Café', {stamp}, 'm', 2L), ('v', 1L, 'V', null, null, 1L) AS t(url, source_id, title, published_at, marker, seq)",
        "revisions": f"SELECT * FROM VALUES (1L, 'u', 'a\r\nb', 'x', {stamp}, 1L), (4L, 'u', 'é', 'x', {stamp}, 2L), (2L, 'w', 'lost', 'x', {stamp}, 2L) AS t(revision_id, url, text, content_hash, fetched_at, seq)",
        "evidence": "SELECT * FROM VALUES ('f', 'https://e.test/', 'T', 'x', 'context', 'retrieved', 'search') AS t(finding_id, url, title, excerpt, relation, status, source_kind)",
        "sources": "SELECT 1L AS id, 'N' AS name, 'https://n.test/map.xml' AS feed_url, cast(null AS string) AS article_url, true AS enabled, 1L AS seq",
    }
    given = {n: spark.sql(q) for n, q in rows.items()}
    for step in MG.STEPS[: format_ - 1]:
        given = step(given)
    tables.commit(given)
    return path


def test_steps_one_by_one(spark, tmp_path):
    first = Tables(spark, first_format(spark, str(tmp_path / "t")), MG.FIRST)
    rows = {n: first.read(n) for n in MG.FIRST}
    one = MG.titled(rows)
    assert sorted((r.revision_id, r.title) for r in one["revisions"].collect()) == [(1, "Café"), (2, ""), (4, "Café")]
    two = MG.normalized(one)
    assert {r.revision_id: (r.title, r.text) for r in two["revisions"].collect()} == {1: ("Café", "a\nb"), 2: ("", "lost"), 4: ("Café", "é")}
    assert two["revisions"].where(F.col("content_hash") != T.content_hash(F.col("title"), F.col("text"))).count() == 0
    three = MG.current(two)
    assert {(r.url, r.current_revision_id) for r in three["articles"].collect()} == {("u", 4), ("v", None)}
    four = MG.sourced(three)
    assert four["evidence"].select("provider", "published_at", "retrieved_at", "content_hash").first() == (None,) * 4


@pytest.mark.parametrize("format_", [1, 3, 4])
def test_older_formats_read_as_the_newest(spark, tmp_path, format_):
    store = Store(spark, first_format(spark, str(tmp_path / "s"), format_))
    want = {1: ("Café", "a\nb"), 2: ("", "lost"), 4: ("Café", "é")}
    assert {r.revision_id: (r.title, r.text) for r in store.log("revisions").collect()} == want
    assert {(r.url, r.current_revision_id) for r in store.articles().where("url = 'u'").collect()} == {("u", 4)}
    version = store.tables.snapshot()["version"]
    assert store.migrate() == version + 1 and store.migrate() == version + 1
    assert store.tables.snapshot()["format"] == MG.NEWEST
    assert {r.revision_id: (r.title, r.text) for r in store.log("revisions").collect()} == want
    assert store.log("evidence").first().title == "T" and store.sources().count() == 1
    assert store.watch(get)["revisions_created"] == 2
