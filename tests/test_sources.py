"""Web data sources, plug-ins from a shell, normal form, decoding and lenient times."""

import os
import subprocess
import sys
from pathlib import Path
from urllib.parse import quote

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressdelta import settings as SE
from pressdelta.operators import analysis as AN
from pressdelta.operators import ingest as IN
from pressdelta.operators import revisions as RV
from pressdelta.sources import datasource as D
from pressdelta.sources import fetch as FE
from pressdelta.sources import markup as M
from pressdelta.sources.fetch import Response
from pressdelta.store import Store
from pressdelta.streaming import revisions as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

ROOT = Path(__file__).resolve().parents[1]
FEEDS = {
    "https://a.test/f.xml": ("application/xml", b"<rss><channel><item><link>https://a.test/1</link><title>One</title></item><item><link>mailto:x</link></item><item><link>https://a.test/2</link></item></channel></rss>"),
    "https://a.test/g.rss": ("text/plain", b"<rss><channel><item><link>https://a.test/3</link></item></channel></rss>"),
    "https://b.test/map": ("text/xml", b"<urlset><url><loc>https://b.test/1</loc><lastmod>2024</lastmod></url></urlset>"),
    "https://c.test/": ("text/html", b"<li><a href='/n'>N</a></li><nav><a href='/no'>no</a></nav>"),
    "https://d.test/bad.xml": ("application/xml", b"<rss"),
}


def get(url):
    if url not in FEEDS:
        raise OSError("refused")
    return Response(200, url, *FEEDS[url])


def test_sources_by_format_equal_the_operators(spark):
    D.register(spark, get)
    urls = [*FEEDS, "https://e.test/", "https://a.test/f.xml"]
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = spark.read.format(D.RESPONSES).option("urls", "\n".join(urls)).load()
    assert sorted(map(str, rows.collect())) == sorted(map(str, FE.responses(asked, get).collect()))
    found = spark.read.format(D.CANDIDATES).option("urls", "\n".join(urls)).load()
    want = M.candidates(FE.responses(asked, get).where("error IS NULL").select("url", "content_type", "body"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 5
    assert found.rdd.getNumPartitions() == 5 and D.by_host(urls)[0] == ["https://a.test/f.xml", "https://a.test/g.rss"]
    with pytest.raises(Exception, match="names no address"):
        spark.read.format(D.CANDIDATES).load().collect()


def test_polls_as_a_stream(spark, tmp_path):
    D.register(spark, get)
    polls = spark.readStream.format(D.CANDIDATES).option("urls", "https://a.test/f.xml\nhttps://b.test/map").option("minutes", "1000000").load()
    for _ in range(2):  # the second run is inside the same interval
        S.run_available(polls, str(tmp_path / "cp"), S.append_once(str(tmp_path / "out")))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://a.test/1", "https://a.test/2", "https://b.test/1"]
    reader = D._Polls(["https://a.test/"], D._found, get, 60, now=lambda: 125)
    assert (reader.initialOffset(), reader.latestOffset()) == ({"poll": 1}, {"poll": 2})
    assert len(reader.partitions({"poll": 1}, {"poll": 2})) == 1 and reader.partitions({"poll": 2}, {"poll": 2}) == []


PLUGIN = """
import json
def make(settings):
    assert settings.llm_api_key == "k"
    def provider(row):
        return json.dumps({"revision_id": int(row["revision_id"]), "claims": [], "candidates": []})
    return provider
def search(settings):
    return lambda query, limit: ()
"""


def page(url):
    host = url.split("/")[2]
    if url.endswith("map.xml"):
        return Response(200, url, "application/xml", f"<urlset><url><loc>https://{host}/1</loc></url></urlset>".encode())
    word = {"a.test": "approved", "b.test": "rejected"}[host]
    return Response(200, url, "text/html", f"<article><p>Taipei Ministry {word} the coastal permit after review.</p></article>".encode())


def test_plug_ins_from_a_shell(spark, tmp_path):
    store = Store(spark, str(tmp_path / "data"))
    for host in ("a.test", "b.test"):
        store.add_source(host, f"https://{host}/map.xml", None)
    assert store.watch(page)["revisions_created"] == 2
    site = tmp_path / "site"
    (site / "made-1.0.dist-info").mkdir(parents=True)
    (site / "made_plugin.py").write_text(PLUGIN)
    (site / "made-1.0.dist-info/METADATA").write_text("Metadata-Version: 2.1\nName: made\nVersion: 1.0\n")
    (site / "made-1.0.dist-info/entry_points.txt").write_text("[pressdelta.providers]\nmade = made_plugin:make\ngone = made_plugin:nothing\n[pressdelta.searches]\nours = made_plugin:search\n")

    def shell(provider):
        env = tmp_path / f"env-{provider}"
        env.write_text(f"DATA_DIR={tmp_path / 'data'}\nLLM_PROVIDER={provider}\nLLM_MODEL=m\nLLM_API_KEY=k\nWEB_SEARCH_PROVIDER=ours\n")
        path = os.pathsep.join([str(site), str(ROOT)])
        conf = f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path / 'shared'} pyspark-shell"
        return subprocess.run([sys.executable, "-m", "pressdelta", "--env-file", str(env), "analyze", "--pending"], env=os.environ | {"PYTHONPATH": path, "PYSPARK_SUBMIT_ARGS": conf, "PYSPARK_PYTHON": sys.executable}, cwd=tmp_path, capture_output=True, text=True, timeout=240)

    done = shell("made")
    assert done.returncode == 0 and "candidates=2 visible_findings=2" in done.stdout, done.stderr[-2000:]
    assert sorted(r.status for r in store.log("outcomes").collect()) == ["completed"] * 2
    for name, why in (("gone", "cannot be loaded"), ("none", "no such provider")):
        bad = shell(name)
        assert bad.returncode == 2 and why in bad.stderr


def test_runtime_and_setup():
    got = SE.load("/nowhere/.env", {"LLM_PROVIDER": "p", "LLM_MODEL": "m", "LLM_API_KEY": "secret", "DATA_DIR": "/d"})
    assert got.runtime() == {"LLM provider": "p", "LLM model": "m", "Web search provider": "none", "Data directory": "/d", "LLM API key": "present"}
    assert got.configured(1) and not got.configured(0) and got.has_llm_key and not got.has_firecrawl_key
    none = SE.load("/nowhere/.env", {})
    assert none.runtime()["LLM API key"] == "missing" and not none.configured(3) and none.missing() == ["LLM_PROVIDER", "LLM_MODEL", "LLM_API_KEY"]


def test_texts_that_are_not_normal_are_not_sent(spark):
    rows = spark.createDataFrame([(1, "Café"), (2, "Café"), (3, "a\r\nb"), (4, None)], "revision_id long, text string")

    def provider(row):
        return f'{{"revision_id": {row["revision_id"]}, "claims": [], "candidates": []}}'

    got = {r.revision_id: r.error for r in AN.answers(rows, provider).collect()}
    assert got == {1: None, 2: "text is not in normal form", 3: "text is not in normal form", 4: "text is not in normal form"}


def test_decoding_goes_on_while_something_changes(spark):
    def nested(text, depth):
        for _ in range(depth):
            text = quote(text, safe="")
        return text

    texts = ["token=x", "plain text", "50% off", "100%25", "a+b", "%zz"]
    rows = spark.createDataFrame([(nested(t, k), t) for t in texts for k in (0, 1, 9, 20)] + [(None, None)], "given string, plain string")
    got = rows.select(AN.decoded(F.col("given")).alias("d"), "plain").collect()
    assert all(r.d == (r.plain if r.plain != "100%25" else "100%") for r in got)
    links = spark.createDataFrame([(k, f"https://e.test/?q={nested('token=x', k)}", f"https://e.test/?q={nested('a b', k)}") for k in (0, 3, 9, 20)], "k int, bad string, good string")
    shown = lambda c: AN.evidence_link(F.col(c), F.lit("t"), F.lit("p"), F.lit("r"))
    assert links.select(shown("bad").alias("l")).where("l IS NOT NULL").count() == 0 and links.select(shown("good").alias("l")).where("l IS NOT NULL").count() == 4


def test_lenient_times_and_metadata_maps(spark):
    times = ["2024-01-01T08:00:00+08:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01 00:00", "2024-01-01", " 2024-01-01T00:00:00.000Z ", "Mon, 01 Jan 2024 00:00:00 GMT", "2024-13-01", "", None]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(F.unix_timestamp(IN.lenient_utc(F.col("t")))).collect()
    assert [r[0] for r in got] == [1704067200] * 6 + [None] * 4
    maps = spark.createDataFrame([('{"a": "x", "b": "é"}',), ("{}",), ("[1]",), ("no",), (None,)], "m string").select(RV.metadata_map(F.col("m"))).collect()
    assert [r[0] for r in maps] == [{"a": "x", "b": "é"}, {}, None, None, None]
