"""Text functions as column expressions; offsets are code points of normalised text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocabulary as V


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def normalize(text: Column) -> Column:
    """Line ends become LF and the text NFC. Python sees only texts that may need composing."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.coalesce(_nfc(F.when(lines.rlike("[^\\x00-\\u02FF]"), lines)), lines)


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(normalize(title), F.lit("\n"), normalize(text)), 256)


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space, none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def _set(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def tokens(text: Column) -> Column:
    return _set(text, V.TOKEN)


def entities(text: Column) -> Column:
    return _set(text, V.ENTITY)


def words(values) -> Column:
    return F.lit(list(values)).cast("array<string>")


def event_words(words_: Column, entities_: Column, drop: Column | None = None) -> Column:
    """Tokens that are no entity of the same text, stopword, number or word of ``drop``."""
    rest = F.array_except(F.array_except(words_, entities_), words(V.STOPWORDS))
    if drop is not None:
        rest = F.array_except(rest, drop)
    return F.filter(rest, lambda t: ~t.rlike(r"(?U)^\d[\d,]*$"))


def event_tokens(text: Column, drop: Column | None = None) -> Column:
    return event_words(tokens(text), entities(text), drop)


def unstopped(found: Column) -> Column:
    return F.array_except(found, words(V.STOPWORDS))


def named(text: Column) -> Column:
    """Entities that are no stopwords."""
    return unstopped(entities(text))


def sentence(text: Column, start: Column, end: Column) -> Column:
    """From after the last sentence mark before ``start`` to before the first after ``end``."""
    run = rf"^[^{V.SENTENCE_MARKS}]*"
    before = F.reverse(F.regexp_extract(F.reverse(text.substr(F.lit(1), start)), run, 0))
    after = F.regexp_extract(text.substr(end + 1, F.length(text)), run, 0)
    return F.concat(before, text.substr(start + 1, end - start), after)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of a sparse pattern, positions carried along in one fold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("between"), found.alias("value"))
    state = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def fold(acc, pair):
        start = acc["at"] + F.length(pair["between"])
        end = start + F.length(pair["value"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.when(pair["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], item).alias("out")))

    return F.aggregate(pairs, state, fold, lambda acc: acc["out"])


def numeric_claims(text: Column) -> Column:
    """array<struct<start,end,digits,phrase,unit,context>>: exact numbers with a unit.

    Approximate numbers, zero, numbers without a unit and dates are no claims. ``digits``
    is the value without commas and leading zeros, so it may have any size.
    """

    def item(s):
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(s["value"], V.NUMBER, 1), ",", ""), "^0+", "")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), digits.alias("digits"),
            collapse(s["value"]).alias("phrase"), F.lower(F.regexp_extract(s["value"], V.NUMBER, 2)).alias("unit"),
            sentence(text, s["start"], s["end"]).alias("context"),
        )

    def exact(s):
        first = F.greatest(s["start"] - 20, F.lit(0))
        unit = F.lower(F.regexp_extract(s["value"], V.NUMBER, 2))
        return ~text.substr(first + 1, s["start"] - first).rlike(V.APPROXIMATE) & s["value"].rlike("[1-9]") & (unit != "") & ~unit.isin(*V.DATE_UNITS)

    return F.transform(F.filter(spans(text, V.NUMBER), exact), item)


def first_five(shared: Column) -> Column:
    """The first five of some words in order, else ``possible topic``."""
    return F.when(F.size(shared) == 0, "possible topic").otherwise(F.array_join(F.slice(F.array_sort(F.array_distinct(shared)), 1, 5), " "))
