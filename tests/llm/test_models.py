"""Machines, dictionaries and merges against direct computations, and bounded samples."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pressdelta.llm import langid, pieces, quality


def test_machine_equals_a_plain_solver():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0.4, 1, (60, 3)), rng.normal(-0.4, 1, (40, 3))])
    y = np.arange(100) < 60
    w = langid.train_svm(x, y, epochs=400, c=0.5)
    full, sign = np.hstack([x, np.ones((100, 1))]), np.where(y, 1.0, -1.0)
    upper = np.where(y, 0.5 * 100 / 120, 0.5 * 100 / 80)
    objective = lambda v: 0.5 * v @ v + (upper * np.maximum(0, 1 - sign * (full @ v))).sum()
    best, v = np.inf, np.zeros(4)
    for k in range(1, 20001):  # subgradient descent on the same problem
        hit = sign * (full @ v) < 1
        v = v - (v - ((upper * sign)[:, None] * full)[hit].sum(axis=0)) / k
        best = min(best, objective(v))
    assert objective(w.astype(float)) <= best * 1.001


def test_values_are_sizes_under_the_two_dictionaries():
    good, bad = b"the quiet river runs along the meadow " * 40, b"buy now cheap pills click here " * 40
    text = "the quiet river runs; click here for cheap pills along the meadow"
    sizes = []
    for d in (good, bad):
        engine = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(len(engine.compress(text.encode())) - len(engine.compress(b"")))
    over = len(text) + quality.PRIOR_BYTES
    difference, share, square = quality.Compressors(good, bad).values(text)
    assert difference == pytest.approx((sizes[1] - sizes[0]) / over) and share == pytest.approx(sizes[0] / over) and square == pytest.approx(share**2)
    assert quality.Compressors(good, bad).values(None) == (0, 0, 0)


def test_encoding_is_merging_by_definition():
    model = pieces.load(pieces.default_model())
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for word, got in zip(words, model.encode_batch(words), strict=True):
        assert [model.pieces[i] for i in got] == model.merged(model.normalize(word)), word


def test_a_repeated_id_does_not_grow_the_sample(spark):
    text = F.concat(F.lit("le petit chat "), F.col("id").cast("string"))
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), text.alias("text"), F.lit("fr").alias("lang"))
    more = spark.range(40).select((F.col("id") + 100).alias("doc_id"), F.lit("the small cat sat").alias("text"), F.lit("en").alias("lang"))
    assert langid.identify(rows.unionByName(more), per_lang=3000).count() == 3040
    labels = spark.createDataFrame([(5, 1), (100, 0)], "doc_id long, quality int")
    assert quality.quality(rows, labels).count() == 3000
