"""Exact top-k against brute force: repeated ids, shards that prune, extra columns and empty tables."""

import numpy as np
import pytest

from pressdelta.llm import topk


def brute(rows, k=5, every=50):
    x = [np.floor(256 * np.float32(v).astype(np.float64)).astype(int) for _, v in rows]
    out = []
    for a, (i, _) in enumerate(rows):
        if i % every == 0:
            scores = sorted(((int(x[a] @ x[b]), j) for b, (j, _) in enumerate(rows) if a != b), key=lambda s: (-s[0], s[1]))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,row", [(50, 4, 2), (4096, 512, 4)])
def test_clustered_vectors(spark, shard, block, row):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=5) * 0.3).tolist()) for i in range(900)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (100, rows[4][1]), (7, rows[100][1])]  # ids that repeat
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, row int, shard int")
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, shard=shard, block=block, row=row).collect())
    assert got == brute(rows)


def test_vectors_of_one_value_and_no_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, shard=16, block=2).collect()) == brute(rows)
    assert topk.exact_top_k(frame.where("false")).collect() == []


def test_one_vector_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_top_k(frame, shard=20, block=3).collect()) == brute(rows)


def test_splits_are_whole_and_even():
    x = np.random.default_rng(1).integers(-500, 500, (4000, 6))
    parts = topk.Splits(x, 40)
    counts = np.bincount(parts.of(x), minlength=parts.parts)
    assert parts.parts == 40 and counts.min() >= 40 and counts.max() <= 160
    assert set(parts.of(x, signs=True)) <= set(range(40))
