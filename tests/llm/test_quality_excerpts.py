"""What of a long text the dictionaries see."""

from pressdelta.llm import quality


def test_excerpts_reach_the_whole_text(spark):
    text = "good start words. " + "é" * 60_000 + " good end words."
    rows = spark.createDataFrame([(1, 1, text), (2, 0, "short")], "doc_id long, quality int, text string")
    got = {r.doc_id: bytes(r.excerpt) for r in quality._excerpts(rows).collect()}
    assert got[2] == b"short" and len(got[1]) <= quality.EXCERPT
    assert got[1].startswith(b"good start words.") and got[1].endswith(b"good end words.")


def test_fit_sees_both_ends(spark):
    docs = [(i, f"begin{i} " + "x" * 30_000 + f" end{i}") for i in range(1, 9)]
    labels = [(i, i % 2) for i, _ in docs]
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    seen = model.good + model.bad
    assert b"begin" in seen and b" end" in seen


def test_a_dictionary_of_few_samples_is_spread():
    samples = [bytes([65 + i]) * 2048 for i in range(60)]
    kept = quality.spread(b"".join(samples), quality.DICTIONARY)
    assert len(kept) <= quality.DICTIONARY and set(kept) == {65 + i for i in range(60)}
