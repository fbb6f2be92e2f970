"""Rows that repeat leave one row of each text or group."""

import pytest

from pressdelta.llm import exact_dedup, neardup

ROWS = [(1, "a b c d e f g", "y"), (1, "a b c d e f g", "x"), (1, "quite another text here", "z"), (2, "a  b c d e f g", "w"), (None, "no number", "u"), (None, "no  number", "v"), (5, "single", "s"), (5, "single", "s")]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, neardup.drop_near_similar])
def test_one_row_of_each_stays(spark, drop):
    out = drop(spark.createDataFrame(ROWS, "doc_id long, text string, note string"))
    assert out.columns == ["doc_id", "text", "note"]
    got = sorted((r.doc_id or 0, " ".join(r.text.split()), r.note) for r in out.collect())
    assert [g[:2] for g in got] == [(0, "no number"), (1, "a b c d e f g"), (1, "quite another text here"), (5, "single")]
    assert got[1][2] == "x" and got[3][2] == "s"
