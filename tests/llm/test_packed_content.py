"""The query and the stage of packing hold every token of every document once, in bins that fit."""

import corpus_pipeline
from pressdelta.llm import queries

SF = "/root/testdata/sf0.001"


def whole(rows):
    """Documents put together from the pieces of their bins; rows of one bin lie in slots without gaps."""
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        docs.setdefault(r.doc_id, []).append((r.first_token, bytes(r.tokens)))
        assert len(r.tokens) == r.n_tokens
    for own in bins.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(len(r.tokens) for r in own) == own[0].bin_tokens <= own[0].bin_length
    for parts in docs.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(len(b) for _, b in parts[:k]) for k in range(len(parts))]
    return {i: b"".join(b for _, b in parts) for i, parts in docs.items()}


def test_query_and_stage_hold_every_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: (r.text or "").encode() + b"\xff" for r in docs.collect()}
    assert whole(queries.op3_best_fit_packing(spark, SF).collect()) == want
    assert whole(corpus_pipeline.pack(spark, docs, SF).collect()) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "tokens" in out.columns
