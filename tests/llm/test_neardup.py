"""The near-copy stage of the pipeline against brute-force Jaccard similarity."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pressdelta.llm import blocks, neardup


def jaccard(a, b):
    def grams(text):
        words = text.encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def survivors(rows):
    root = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if jaccard(a, b) >= 0.8:
            x, y = root[i], root[j]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return sorted(i for i, r in root.items() if r == i)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=300)
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 9, 15, 30):  # similarities from 0.97 down to below 0.5
            copy = list(base)
            for at in rng.sample(range(300), changes):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return list(enumerate([*texts, "", "one two", "One  two", "one two three"]))


def test_near_stage_reaches_four_fifths(spark):
    rows = corpus(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == survivors(rows)


def test_blocks_of_buckets_are_compared_in_full(spark):
    rows = corpus(random.Random(12))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", neardup.text_id())
    ids = {r.id: r.doc_id for r in docs.collect()}
    for block in (2, 256):
        root = {ids[r.id]: ids[r.root] for r in neardup.near_components(docs, block=block).collect()}
        groups = {}
        for i, _ in rows:
            groups.setdefault(root.get(i, i), []).append(i)
        assert sorted(min(g) for g in groups.values()) == survivors(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in rng.choices(range(4000), k=150)]
    texts = []
    for _ in range(400):  # similarities spread around the limit, as in a template's copies
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 12)):
            copy[at] = f"x{rng.randrange(4000)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(dict.fromkeys(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = sorted(r.doc_id for r in neardup.drop_near_similar(docs).collect()), survivors(rows)
    assert set(want) <= set(got) and len(got) <= len(want) + 3  # what the probes may miss, never a false link


def test_recall_of_partitions_at_the_threshold():
    rng = np.random.default_rng(5)
    parts = [(w, list(range(16 * k, 16 * k + 16))) for w in range(neardup.WORDS) for k in range(4)]
    flat = [np.array([math.comb(16, d) / 2**16 for d in range(17)])] * len(parts)
    thresholds = neardup.allocate([16] * len(parts), flat, 10**6)[1]
    met = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        differ = neardup.fingerprint(x[:324]) ^ neardup.fingerprint(x[36:])  # 288 of 360 shared
        met += any(t >= 0 and int(differ[w] & np.uint64(sum(1 << b for b in bits))).bit_count() <= t for (w, bits), t in zip(parts, thresholds, strict=True))
    assert met >= 288


def test_fingerprint_is_the_majority_of_shingle_bits():
    hashes = neardup.shingles(" ".join(f"w{i}" for i in range(700)))
    one = [neardup.fingerprint(hashes[i : i + 1]) for i in range(len(hashes))]
    bits = sum(np.unpackbits(o.view(np.uint8), bitorder="little").astype(int) for o in one) * 2 > len(hashes)
    assert (np.packbits(bits, bitorder="little").view(np.uint64) == neardup.fingerprint(hashes)).all()


def test_near_stage_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.drop_near_similar(docs).collect()) == [3, 7]
    assert neardup.drop_near_similar(docs.where("false")).count() == 0


def test_members_of_one_component_are_not_compared_again(spark):
    """A bucket of one component leaves no later unit, and outsiders meet every member of it."""
    members = spark.range(1000).selectExpr("id", "1 AS part", "2L AS value")
    sizes = blocks.bucket_sizes(members)
    one = spark.range(1000).selectExpr("id AS node", "0L AS root")
    assert blocks.later_units(members, sizes, one, 50).isEmpty()
    known = one.where("node < 970")
    assert blocks.later_units(members, sizes, known, 1000) is None
    units = [(r.id, r.root, r.i, r.j) for r in blocks.later_units(members, sizes, known, 50).collect()]
    assert sorted(units) == sorted((r.id, r.root, r.i, r.j) for r in blocks.later_units(members, sizes, known, 50, sent=0).collect())
    assert len(units) == 970 + 30 * (20 + 1)
    where = {}
    for i, _, a, b in units:
        where.setdefault(i, set()).add((a, b))
    assert all(where[x] & where[y] for x in range(970, 1000) for y in range(1000))
    first = [(r.id, r.i, r.j) for r in blocks.first_units(members, sizes, 50, pivots=10).collect()]
    assert {i for i, _, _ in first} == set(range(1000)) and all(a == b for _, a, b in first)
    assert 1000 < len(first) < 1000 + 20 * 40


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    rows = corpus(random.Random(13))
    rows += [(i + 1000, t) for i, t in rows[:20]]  # equal texts stay one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.clashes(docs) == []
    monkeypatch.setattr(neardup, "_digest", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    assert sorted(neardup.clashes(docs)) == list(range(7))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == survivors(rows)
    monkeypatch.setattr(neardup, "CLASHES", 3)
    with pytest.raises(ValueError):
        neardup.clashes(docs)
