"""Packing against the optimum of small cases, joint choice of lengths, and the packed bytes."""

import itertools
import random

from pressdelta.llm.packing import LENGTHS, cost, pack, packed_sequences


def total(sizes, lengths):
    where, final = pack(sizes, lengths)
    used = [sum(n for n, b in zip(sizes, where, strict=True) if b == k) for k in range(len(final))]
    assert all(u <= c and not any(u <= smaller < c for smaller in lengths) for u, c in zip(used, final, strict=True))
    return sum(map(cost, final))


def optimum(sizes, lengths):
    best, most = float("inf"), max(lengths)

    def go(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(next(c for c in lengths if c >= b)) for b in bins))
            return
        for b in range(len(bins) + 1):
            if b == len(bins):
                go(k + 1, [*bins, sizes[k]])
            elif bins[b] + sizes[k] <= most:
                go(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])

    go(0, [])
    return best


def test_close_to_the_optimum():
    rng, ratios = random.Random(1), []
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 300), rng.randint(300, 1200), rng.randint(1200, 4096)]) for _ in range(7)]
        lengths = (512, 1024, 4096)
        ratios.append(total(sizes, lengths) / optimum(sizes, lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.08


def test_lengths_compete_by_what_fills_them():
    assert pack([1100] * 7)[1] == [8192]  # seven fill a long bin better than seven short ones
    assert pack([2040] * 5)[1] == [2048] * 5
    assert pack([1100])[1] == [2048] and pack([])[1] == []
    mixed = [2000, 1100, 1100, 1100, 1100, 1100, 1100, 1100, 40]
    for subset in itertools.combinations(LENGTHS, 2):
        if max(mixed) <= max(subset):
            assert total(mixed, LENGTHS) <= total(mixed, subset) + 1e-9


def test_sequences_hold_every_byte(spark):
    rows = [(1, "one text"), (2, None), (3, ""), (4, "é" * 5000), (None, "no id"), (5, "x" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in packed_sequences(docs, (64, 4096), 3).collect():
        at = 0
        assert len(r.tokens) <= r.bin_length
        for s in r.segments:
            found.setdefault(s.doc_id, {})[s.first_token] = bytes(r.tokens[at : at + s.n_tokens])
            at += s.n_tokens
        assert at == len(r.tokens)
    assert {i: b"".join(p[k] for k in sorted(p)) for i, p in found.items()} == {i: (t or "").encode() + b"\xff" for i, t in rows}
