"""Every pipeline stage on nulls, empty, long and repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline

CLASH = ("_id", "_key", "_sha", "_spans", "_folded", "_new", "row", "id", "key", "n", "spans", "masked", "part", "words", "root", "lang_pred", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
LONG = " ".join(f"word{i} goes" for i in range(40_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and mails a@b.org today"), (2, "the quick brown  fox jumps over the lazy dog and mails a@b.org today"),
    (2, "the quick brown  fox jumps over the lazy dog and mails a@b.org today"), (None, "a text without a number that nobody else has in this table"),
    (None, "a text without a number that nobody else has in this table"), (3, None), (4, ""), (5, "  \n"), (6, LONG), (7, LONG + " end"), (8, "!!! 123"),
]
ROWS = [(i, t, "en", "s", len(t or ""), *range(len(CLASH))) for i, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_edges(spark, docs, name, stage):
    out = stage(spark, docs, "")
    rows = out.collect()
    assert stage(spark, docs.where("false"), "").collect() == []
    if name == "pack":
        assert {r.doc_id for r in rows} == {i for i, _ in TEXTS} and sum(r.n_tokens for r in rows) == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
        return
    assert out.columns == docs.columns
    assert all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in rows)
    ids = sorted((r.doc_id or 0, bool(r.text)) for r in rows)
    if name == "language_id":
        assert {i for i, _ in ids} >= {0, 1, 2, 6, 7} and not {i for i, _ in ids} & {3, 4, 5, 8}
    if name == "exact_dedup":
        assert [i for i, _ in ids] == [0, 1, 3, 5, 6, 7, 8]
    if name == "near_dedup":
        assert [i for i, _ in ids] == [0, 1, 3, 6, 8]
    if name == "mask_personal_data":
        assert len(rows) == len(ROWS)
        assert {r.text for r in rows if r.doc_id == 1} == {TEXTS[0][1].replace("a@b.org", "[EMAIL]")}
        assert all(r.n_chars == len(r.text or "") for r in rows if r.text is not None)
