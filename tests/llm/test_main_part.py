"""No article text is lost to names or to what pages share; slots alone find the article; whole hosts by hand."""

import html
import re

import pytest
from pyspark.sql import functions as F

from pressdelta.llm import htmltext

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def article(page):
    inner = re.search("<article[^>]*>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|div)[^>]*>", inner)]
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def right(spark, pages, change):
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame([(i, u, change(h)) for i, u, h in pages], SCHEMA)).collect()}
    return sum(got[i] == article(h) for i, _, h in pages) / len(pages)


@pytest.mark.parametrize("name", ["social-policy", "share-prices", "notice-board", "x-y"])
def test_names_cost_no_text_in_a_marked_part(spark, pages, name):
    assert right(spark, pages, lambda h: h.replace("<p>", f'<p class="{name}">')) == 1
    assert right(spark, pages, lambda h: h.replace("<article>", f'<article><div class="{name}">').replace("</article>", "</div></article>")) == 1


def unnamed(page):
    return re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page)


def test_slots_alone_find_the_article(spark, pages):
    assert right(spark, pages, unnamed) >= 0.95
    assert right(spark, pages, lambda h: unnamed(h).replace('class="ad"', 'class="x"')) >= 0.95
    assert right(spark, pages, lambda h: unnamed(h.replace("<article>", '<article class="social-story">'))) >= 0.95


@pytest.mark.parametrize("note", ["A short note of five", "A long note " + "of many words " * 13])
@pytest.mark.parametrize("n", [1, 12])
def test_what_articles_share_stays(spark, note, n):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Daily briefing</h1><p>{1}</p><p>Story {0}</p></article><footer>f</footer></body>"
    rows = [(i, "https://h.test/", page.format(i, note)) for i in range(n)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Daily briefing\n\n{note.strip()}\n\nStory {i}" for i in range(n)}


def test_side_elements_by_name_need_more_than_a_name():
    page = '<div class="{0}"><p>Long story text of the page</p></div><div>x</div>'
    assert htmltext.main_text(page.format("related-story")) == "Long story text of the page"
    links = '<div><p>Long story text of the page</p><div class="related-links"><a href="/a">One more story</a></div><div class="comments"><p>First!</p></div></div>'
    assert htmltext.main_text(links) == "Long story text of the page"


# -- templates of whole hosts, one occurrence vector at a time -----------------------------


def plain_template(rows):
    """The template of one host's distinct pages from vectors held whole."""
    pages = list(dict.fromkeys(rows))
    counts = [htmltext.page_tokens(p) for p in pages]
    vector = {}
    for tokens, _ in counts:
        for t in tokens:
            vector[t] = tuple(c[t] for c, _ in counts)
    tags = set().union(*(tags for _, tags in counts)) if counts else set()
    if len(pages) < htmltext.MIN_PAGES:
        return set()
    classes = {}
    for t, v in vector.items():
        if sum(map(bool, v)) >= htmltext.MIN_PAGES:
            classes.setdefault(v, set()).add(t)
    root = (1,) * len(pages)
    out = set()
    for v, own in classes.items():
        on = sum(map(bool, v))
        enough = len(own) + (v == root) >= htmltext.MIN_TOKENS and (len(own) + (v == root)) * on >= htmltext.EVIDENCE
        if not enough or not (v == root or on >= len(pages) * htmltext.SHARE or own & tags):
            continue
        orders = set()
        for p, n in zip(pages, v, strict=True):
            gap, order = 0, []
            for kind, path, value, _, _ in htmltext.walk(p) if n else ():
                if kind == "tag" or kind == "text" and value.strip():
                    t = htmltext._key(path, value if kind == "text" else "")
                    gap += t in classes.get(root, ())
                    if t in own:
                        order.append((t, gap))
            if n:
                orders.add(tuple(order))
        if len(orders) == 1:
            out |= own
    return out


def test_templates_equal_those_of_whole_vectors(spark, pages):
    renamed = [(i, u, unnamed(h)) for i, u, h in pages]
    rows = spark.createDataFrame(renamed, SCHEMA).select("html", htmltext._host().alias("host"), F.xxhash64("page_id", "url", "html").alias("ident"))
    apart = htmltext.distinct_pages(rows)
    classes = htmltext.materialize(htmltext.candidates(apart), "classes")
    found = {r.host: set(r.template) for r in htmltext.templates(apart, classes, 10**6).collect()}
    hosts = {}
    for r in rows.select("host", "html").collect():
        hosts.setdefault(r.host, []).append(r.html)
    assert len(hosts) > 3
    for host, own in hosts.items():
        assert found.get(host, set()) == plain_template(own), host


def test_edges(spark):
    long = "<article>" + "<p>word " * 60_000 + "</article>"
    rows = spark.createDataFrame([(1, "https://h.test/", long), (1, "https://h.test/", long), (2, None, None), (None, "no address", "<p>x")], SCHEMA).withColumn("text", F.lit("t"))
    got = htmltext.extract(rows).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 60_000 * 4 + 59_999 * 2), (1, 60_000 * 4 + 59_999 * 2), (2, 0)]
    assert htmltext.extract(rows.where("false")).collect() == []
