"""Templates of hosts with few pages, and copies that count once."""

import pytest

from pressdelta.llm import htmltext

PAGE = "<body><div>Site name</div><ul><li>Home<li>World<li>Sport<li>Money</ul><div><span>Share this</span><p>Story {0} of many</p></div><h6>Contact us</h6><div>All rights</div></body>"


def texts(spark, pages):
    rows = [(i, f"https://h.test/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("n", [2, 3, 5, 7])
def test_few_pages_have_a_template(spark, n):
    assert texts(spark, [PAGE.format(i) for i in range(n)]) == {i: f"Story {i} of many" for i in range(n)}


def test_seven_pages_of_a_small_layout(spark):
    page = "<body><div>Site name</div><div><span>Share this</span><p>Story {0} of many</p></div><div>All rights</div></body>"
    assert texts(spark, [page.format(i) for i in range(7)])[3] == "Story 3 of many"


def test_copies_are_one_page(spark):
    alone = texts(spark, [PAGE.format(0)])[0]
    assert set(texts(spark, [PAGE.format(0)] * 9).values()) == {alone} and "Story 0 of many" in alone
    assert set(texts(spark, [PAGE.format(0)] * 20 + [PAGE.format(1)]).values()) == {"Story 0 of many", "Story 1 of many"}


def test_two_short_pages_are_too_little_evidence(spark):
    assert texts(spark, ["<p>Same</p><p>a</p>", "<p>Same</p><p>b</p>"])[0] == "Same\n\na"
