"""Settings, commands and the store with functions in place of the network."""

import json
import sys

import pytest
from pyspark import cloudpickle

from pressdelta import __main__ as cli
from pressdelta import settings as S
from pressdelta.sources.fetch import Response
from pressdelta.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

TEXTS = {
    "https://a.test/1": "Taipei Ministry approved the coastal permit. Taipei Ministry reports 100 workers deployed at the coastal exercise.",
    "https://b.test/1": "Taipei Ministry rejected the coastal permit. Taipei Ministry reports 1000 workers deployed at the coastal exercise.",
}


def get(url):
    if url.endswith("map.xml"):
        return Response(200, url, "application/xml", f"<urlset><url><loc>{url.removesuffix('map.xml')}1</loc><lastmod>1</lastmod></url></urlset>".encode())
    return Response(200, url, "text/html", f"<title>x</title><article><p>{TEXTS[url]}</p></article>".encode())


def provider(row):
    return json.dumps({"revision_id": int(row["revision_id"]), "claims": [], "candidates": []})


def test_settings():
    with_file = S.lines("# c\nLLM_PROVIDER = 'p'\n=x\nnone\nGEMINI_MODEL=old\nLLM_API_KEY=\"k\"")
    assert with_file == {"LLM_PROVIDER": "p", "GEMINI_MODEL": "old", "LLM_API_KEY": "k"}
    got = S.load("/nowhere/.env", with_file)
    assert (got.llm_model, got.missing(), got.poll_interval_minutes) == ("old", [], 60) and "k" not in repr(got).split("llm_model")[0]
    assert S.load("/nowhere/.env", with_file | {"LLM_MODEL": ""}).missing() == ["LLM_MODEL"]
    assert S.load("/nowhere/.env", with_file | {"WEB_SEARCH_PROVIDER": "firecrawl"}).missing() == ["FIRECRAWL_API_KEY"]
    for bad in ("0", "-1", "x", "1.5"):
        with pytest.raises(ValueError):
            S.load("/nowhere/.env", {"POLL_INTERVAL_MINUTES": bad})


def test_commands(spark, tmp_path, monkeypatch, capsys):
    env = tmp_path / "env"
    env.write_text(f"DATA_DIR={tmp_path / 'data'}\nLLM_PROVIDER=made\nLLM_MODEL=m\nLLM_API_KEY=k\n")
    run = lambda *args: cli.main(["--env-file", str(env), *args], spark)
    assert run("source", "add", "--name", "A", "--feed-url", "https://a.test/map.xml") == 0
    assert run("source", "add", "--name", "B", "--feed-url", "https://b.test/map.xml") == 0
    assert run("source", "add", "--name", "A again", "--feed-url", "https://a.test/map.xml") == 0
    assert run("source", "add", "--name", " ", "--feed-url", "https://a.test/x") == 2
    assert run("source", "add", "--name", "C", "--feed-url", "ftp://a.test/x") == 2
    assert run("source", "disable", "--id", "9") == 2 and run("source", "disable", "--id", "2") == 0
    monkeypatch.setattr(Store.watch, "__defaults__", (get,))
    monkeypatch.setattr(Store.analyze, "__defaults__", (get,))
    assert run("watch", "--once") == 0 and run("source", "enable", "--id", "2") == 0 and run("watch", "--once") == 0
    said = capsys.readouterr().out
    assert "sources_checked=1 candidates_seen=1 revisions_created=1 failures=0" in said
    assert "sources_checked=2 candidates_seen=2 revisions_created=1 failures=0" in said
    assert run("source", "list") == 0 and "2\tenabled\tB\thttps://b.test/map.xml" in capsys.readouterr().out
    assert run("analyze", "--pending", "--limit", "0") == 2 and run("analyze", "--pending") == 2  # no such provider
    monkeypatch.setitem(cli.PROVIDERS, "made", lambda settings: provider)
    capsys.readouterr()
    assert run("analyze", "--pending") == 0
    assert capsys.readouterr().out.strip() == "claims=0 candidates=2 visible_findings=2 pending=0 retrieval_failures=0"
    assert run("analyze", "--pending") == 0 and "candidates=0" in capsys.readouterr().out
    assert run("report") == 0 and "revisions=2 articles=2" in capsys.readouterr().out
