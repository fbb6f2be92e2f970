"""Column functions against literal cases and Python's own re and urllib."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressdelta.functions import redact as R
from pressdelta.functions import text as T
from pressdelta.functions import urls as U

TEXTS = ["", "Taipei Council approved 1,200 workers.", "約500位 近 500 位 有300位 台北市政府", "The café don't 12,3 x-ray É", "about 450 troops, over 9 days; 100 troops and 0 ships", "😀 20 ships left. No 7 boats"]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("text", TEXTS)
def test_token_sets_match_python(spark, text):
    words = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9'-]{2,}|[一-鿿]{2,}|\d[\d,]*", text)}
    assert set(one(spark, T.tokens, text)) == words


@pytest.mark.parametrize("text", TEXTS)
def test_numeric_spans_quote_the_text(spark, text):
    for c in one(spark, T.numeric_claims, text):
        assert text[c.start : c.end].strip() == c.phrase
        assert c.context in text and c.unit and c.digits


def test_numeric_claims_drop_approximate_dates_and_zero(spark):
    assert [(c.digits, c.unit) for c in one(spark, T.numeric_claims, TEXTS[4])] == [("100", "troops")]
    assert [(c.start, c.digits) for c in one(spark, T.numeric_claims, TEXTS[5])] == [(2, "20"), (20, "7")]
    assert one(spark, T.numeric_claims, "約500位 近 500 位") == []


def test_normalize_composes_and_unifies_line_ends(spark):
    raw = "Café\r\nx\ry"
    assert one(spark, T.normalize, raw) == unicodedata.normalize("NFC", raw).replace("\r\n", "\n").replace("\r", "\n")
    assert one(spark, T.normalize, None) is None


def test_sentence_between_marks(spark):
    column = lambda v: T.sentence(v, F.lit(7), F.lit(9))
    assert one(spark, column, "One. Two three! Four") == " Two three"


@pytest.mark.parametrize(
    "url,safe,canonical",
    [
        ("HTTPS://A.Test:80/X?q=1#f", "https://a.test:80/X", "https://a.test:80/X?q=1"),
        ("https://u:p@a.test/x", "", None), ("ftp://a.test/", "", None), ("not a url", "", None), ("https:///x", "", None),
        ("https://a.test/b c?d e", "https://a.test/b c", "https://a.test/b c?d e"),
    ],
)
def test_urls(spark, url, safe, canonical):
    assert one(spark, U.safe, url) == safe
    assert one(spark, U.canonical, url) == canonical


@pytest.mark.parametrize("url,good", [("https://a.test/x", True), ("https://a.test:99999/", False), ("https://@a.test/", False), ("https://a b.test/", False), ("mailto:x", False), (None, False)])
def test_strict_source_url(spark, url, good):
    assert one(spark, U.strict, url) is good


def test_redaction(spark):
    text = "Authorization: Bearer abc\nsee https://x.test/?token=q1&a=2 password = hunter2, bearer zzz"
    out = one(spark, R.redact, text)
    assert "abc" not in out and "q1" not in out and "hunter2" not in out and "zzz" not in out and "a=2" in out
    assert one(spark, U.redact_url, "https://u:p@a.test/p?api%5Fkey=s&b=%7E&c#token=z") == "https://a.test/p?api_key=%2A%2A%2A&b=~&c=#token=***"
    assert one(spark, R.safe_error, None) is None
