"""Spelling variants, repeated windows and divergences against brute force, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressdelta.llm import divergence, variants, windows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, key long, h long, n long, term string"
LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "épsilon", "日本"]) for _ in range(60_000))
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "b"), (4, "one two three", None, "a"), (4, "one two three", None, "a"), (None, "x " * 50, "en", "a"), (None, "x " * 50, "en", "a"),
    (None, None, None, None), (6, LONG, "en", "b"), (7, LONG + " end", "en", "c"), (8, "Émile 日本 😀 Ärger", "de", "a"), (9, "The quick brown fox. " * 40, "en", "a"), (9, "The quick brown fox. " * 41, "en", "b"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "w", 1, 2, 3, "t") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df, *names):
    return sorted(map(str, [tuple(r) for r in df.select(*names).collect()]))


# -- spelling variants ------------------------------------------------------------------


def lowered(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows, least):
    n = Counter()
    for i, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(map(str, out))


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("least", [1, 5])
def test_variants_equal_brute_force(spark, least):
    rng = random.Random(1)
    stems = ["kitten", "sitting", "färben", "farben", "ébauché", "ebauche", "abcdefgh", "abcdefhg", "zzzzzzz", "straße"]
    rows = [(i, " ".join(rng.choice(stems) if rng.random() < 0.7 else "".join(rng.choice("aàáßxyz÷") for _ in range(rng.randint(5, 7))) for _ in range(400)).upper().replace("SS", "ß")) for i in range(12)]
    rows += [(i + 50, t.lower()) for i, t in rows] + [(None, "kitten Kitten kItten"), (3, None)]
    got = variants.spelling_variants(table(spark, [(i, t, None, None) for i, t in rows]), least=least)
    assert collected(got, *NAMES) == brute_variants(rows, least)


def test_variants_of_documents(spark):
    some = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert collected(variants.spelling_variants(documents(spark)), *NAMES) == brute_variants(some, 5)


def test_chains_of_forms_end_at_the_last(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e"), ("e", "f")]
    assert dict(variants.roots(spark.createDataFrame(links, "word string, form string")).collect()) == {w: "f" for w, _ in links}


def test_one_edit_flips_two_bits_at_most(spark):
    rng, letters = random.Random(2), "abcdefghijklmnopqrstuvwxyzàéßÿ÷"
    pairs = []
    for _ in range(500):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        i, c = rng.randrange(len(w)), rng.choice(letters)
        pairs += [(w, w[:i] + w[i + 1 :], 1), (w, w[:i] + c + w[i:], 1), (w, w[:i] + c + w[i + 1 :], 2)]
    flips = F.bit_count(variants.mask(F.col("a")).bitwiseXOR(variants.mask(F.col("b"))))
    assert spark.createDataFrame(pairs, "a string, b string, most int").where((flips > F.col("most")) | ((F.col("most") == 1) & (flips != 1))).count() == 0


def test_bands_split_all_bits(spark):
    words = spark.createDataFrame([(w,) for w in ("kitten", "abacus", "zephyr", "queueing")], "word string").select(variants.mask(F.col("word")).alias("mask"))
    for rows in (words, words.where("false")):
        a, b, c = (x % (1 << 64) for x in variants.bands(rows))
        assert (a | b | c) == (1 << 64) - 1 and a & b == b & c == a & c == 0


def test_variants_edges(spark, edge):
    assert collected(variants.spelling_variants(edge), *NAMES) == brute_variants([r[:2] for r in EDGE], 5)
    assert variants.spelling_variants(edge.where("false")).collect() == []


# -- repeated windows -------------------------------------------------------------------


def keys(df):
    return [(r.doc_id, r.text, r.key_) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))).alias("key_")).collect()]


def brute_windows(rows, size):
    last = (1 << 63) - 1
    docs = [((last if i is None else i, k), i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, k in rows]
    first = {}
    for order, _, words in docs:
        for p in range(len(words) - size + 1):
            key = tuple(words[p : p + size])
            first[key] = min(first.get(key, (order, p)), (order, p))
    out = []
    for order, i, words in docs:
        gone = set()
        for p in range(len(words) - size + 1):
            if first[tuple(words[p : p + size])] != (order, p):
                gone.update(range(p, p + size))
        left = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(map(str, out))


SHAPE = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("window", [13, 20, 31])
def test_windows_equal_brute_force(spark, window):
    rng = random.Random(window)
    pool = [" ".join(rng.choice("abcd") * rng.randint(1, 12) for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 6))).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["new", "é", "x" * 300])
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t "]) for w in words), None, None))
    rows += [(100 + i, "go on " * n, None, None) for i, n in enumerate((5, 40, 200))] + [(7, rows[3][1], None, None), (7, rows[7][1], None, None), (None, rows[9][1], None, None), (None, rows[11][1], None, None)]
    docs = table(spark, rows)
    assert collected(windows.substring_dedup(docs, window), *SHAPE) == brute_windows(keys(docs), window)


def test_windows_of_documents(spark):
    assert collected(windows.substring_dedup(documents(spark)), *SHAPE) == brute_windows(keys(documents(spark)), 20)


def test_windows_edges(spark, edge, monkeypatch):
    want = brute_windows(keys(edge), 20)
    assert collected(windows.substring_dedup(edge), *SHAPE) == want
    assert windows.substring_dedup(edge.where("false")).collect() == []
    with pytest.raises(ValueError):
        windows.substring_dedup(edge, period=14)
    with pytest.raises(ValueError):
        windows.substring_dedup(edge, window=12)


def test_spans_of_words_have_equal_hashes_where_words_are_equal():
    data = np.frombuffer(b"a bb ccc a bb ccc " + b"z" * 200 + b" a bb ccd", dtype=np.uint8)
    starts, ends, _ = windows.split(data, np.array([0, len(data)]))
    for lane in windows._SEEDS:
        three = windows.spans(windows.hashed(data, starts, ends, lane), 3, lane).tolist()
        assert three[0] == three[3] and len(set(three)) == len(three) - 1


# -- divergences ------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", g or "", s or "") for _, t, g, s in rows):
        terms = list(map(lowered, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(c):
            whole = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (whole + v) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part in (pair, term):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k) for k, x in enumerate(ranked, 1) if x[0] == "pair" or k <= top]
    return sorted(map(str, out))


RESULT = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "Beta", "straße", "日本", "é", "x", "ab'c", "Ω-mega", "no1one"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 + (k * i) % 7 for k in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None])) for i in range(80)]
    rows += [(200, "lonely", "xx", "a"), (201, "", "xx", "b"), (202, None, "yy", "a")]
    monkeypatch.setattr(divergence, "PAIRS", 7)
    got = divergence.divergence(table(spark, rows), top=4)
    assert collected(got, *RESULT) == brute_divergence(rows, 3, 4)


def test_equal_digests_are_told_apart():
    data = np.frombuffer(b"aa bb aa cc bb dd aa", dtype=np.uint8)
    starts, ends = divergence.slices(data)
    for digest in (lambda b: 0, lambda b: b[0] & 1, divergence.xxhash.xxh3_64_intdigest):
        first, group = divergence.grouped(data, starts, ends, digest)
        names = [bytes(data[starts[i] : ends[i]]) for i in first]
        assert len(set(names)) == 4 and [names[g] for g in group] == [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("stretch", [8, 64])
def test_long_texts_are_counted_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(divergence, "STRETCH", stretch)
    text = ("ab cd " * 20 + "e" * 50 + " ab " + "f" * 9).encode()
    assert divergence._long(np.frombuffer(text, dtype=np.uint8)) == Counter(re.findall(rb"[a-z]+", text))


def test_frequencies_do_not_overflow(spark):
    cases = [(0, 1), (3, 7), (10**15, 9 * 10**15), (8 * 10**15, 9 * 10**15 - 1), (999, 1000)]
    got = spark.createDataFrame(cases, "n long, whole long").select("n", "whole", divergence.frequency(F.col("n"), F.col("whole")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.whole for r in got) and math.isclose(len(got), len(cases))


def test_divergence_edges(spark, edge):
    assert collected(divergence.divergence(edge), *RESULT) == brute_divergence(EDGE, 3, 200)
    assert divergence.divergence(edge.where("false")).collect() == []
