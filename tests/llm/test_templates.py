"""Layouts, order and slots: what the template method decides without names of elements."""

from pressdelta.llm import htmltext


def texts(spark, pages):
    rows = [(i, f"https://h.test/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


STORY = "<p>Story {0} began here, and it was told at some length to all.</p><p>Then story {0} went on for a while and ended.</p>"
HEAD = "<div><span>Site name</span><b>All the news</b><i>since 1900</i></div>"


def test_slots_without_any_name(spark):
    page = "<body>" + HEAD + "<table><tr><td>Item {1}<td>Item {2}</table><div>" + STORY + "</div><ol><li>Rights</ol></body>"
    got = texts(spark, [page.format(i, i * 3, i * 7) for i in range(10)])
    assert got == {i: f"Story {i} began here, and it was told at some length to all.\n\nThen story {i} went on for a while and ended." for i in range(10)}


def test_each_layout_has_its_template(spark):
    one = "<body>" + HEAD + "<div>" + STORY + "</div></body>"
    two = "<body>" + HEAD + "<section><u>Sport pages</u><s>Scores of today</s><em>Tables</em><div>" + STORY + "</div><q>More sport</q></section></body>"
    got = texts(spark, [(two if i % 3 == 0 else one).format(i) for i in range(18)])
    assert got == {i: f"Story {i} began here, and it was told at some length to all.\n\nThen story {i} went on for a while and ended." for i in range(18)}


def test_what_changes_its_order_is_no_template(spark):
    words = ["Alpha came first", "Beta came second", "Gamma came third", "Delta came last"]
    pages = []
    for i in range(12):
        turned = words[i % 4 :] + words[: i % 4]
        pages.append("<body><article>" + "".join(f"<p>{w}</p>" for w in turned) + f"<p>And {i}</p></article></body>")
    assert all(all(w in t for w in words) for t in texts(spark, pages).values())


def test_text_that_some_pages_repeat_stays(spark):
    quoted = "".join(f"<p>Quoted paragraph {k} of a well known speech.</p>" for k in range(8))
    pages = ["<body>" + HEAD + "<div>" + STORY.format(i) + (quoted if i % 4 == 0 else "") + "</div></body>" for i in range(16)]
    assert texts(spark, pages)[4].count("Quoted paragraph") == 8


def test_names_never_empty_an_article(spark):
    assert htmltext.main_text('<article class="article related"><p>Good text</p></article>') == "Good text"
    assert htmltext.main_text('<main id="footer-main"><p>Body</p><div class="ad">x</div></main>') == "Body"
