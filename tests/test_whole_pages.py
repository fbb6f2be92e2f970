"""List pages are read whole: every anchor, however many there are and however long the page is."""

import duckdb

from pressdelta import vocabulary as V
from pressdelta.plans import catalogue
from pressdelta.sources import markup as M


def test_list_pages_lose_no_candidates(spark, tmp_path):
    """Candidates past the 500th, and all of pages above a million bytes, were once dropped."""
    anchors = lambda n: "".join(f'<a href="/{i}">Story {i}</a>' for i in range(n))
    pages = [(1, "https://e.test/many", f"<main>{anchors(3 * V.MAX_CANDIDATES)}</main>"), (2, "https://e.test/long", f"<p>{'x' * (V.MAX_BYTES + 1)}</p>{anchors(2)}"), (3, "https://e.test/none", ""), (4, "https://e.test/null", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["html_list_links"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["html_list_links"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3 * V.MAX_CANDIDATES + 2


def test_rows_leave_in_small_batches_of_whole_feeds(spark):
    items = "".join(f"<item><link>https://x.test/{i}</link></item>" for i in range(M.TOGETHER + V.MAX_CANDIDATES))
    rows = [("https://s.test/f.xml", "text/xml", f"<rss><channel>{items}</channel></rss>".encode())]
    responses = spark.createDataFrame(rows, "url string, content_type string, body binary")
    assert sorted(r.pos for r in M.candidates(responses).collect()) == list(range(M.TOGETHER + V.MAX_CANDIDATES))
    assert M.candidates(responses, limit=7).count() == 7
