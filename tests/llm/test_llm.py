"""Every operator against brute force, an exact round trip or held-out accuracy, and edge cases."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pressdelta.llm import exact_dedup, htmltext, langid, packing, pieces, pii, quality, queries, simhash, suffix_dedup, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, keep_id long, component_id long, h long"
LONG = "".join(random.Random(5).choice("abc d") for _ in range(300_000))
EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "a b c d"), (5, "a  b\tc d"), (5, "a  b\tc d"), (None, "a b c d"), (None, None), (6, LONG), (7, LONG + "x"), (8, "Émile 日本 😀 x@y.z"), (9, "The quick brown fox. " * 40)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, 0, 0, 0) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(spark):
    return [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    key = sorted(got.columns)
    assert sorted(map(tuple, got[key].astype(str).values.tolist())) == sorted(map(tuple, want[key].astype(str).values.tolist()))


# -- op1 ----------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, tau=3):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and bin(a ^ b).count("1") <= tau:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def test_simhash_equals_brute_force(spark):
    rows = rows_of(spark)
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    classes = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(documents(spark)).collect()}
    assert got == {i: (f"{f:016x}", classes[i]) for i, f in fps}


def test_simhash_links_chains_in_one_bucket(spark):
    rng = random.Random(3)
    fps, x = [], rng.getrandbits(64)
    for _ in range(700):  # a chain of close fingerprints, far longer than a block
        fps.append(x)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            x ^= 1 << b
    fps = list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(200)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, first long")
    want = brute_components(list(enumerate(fps)))
    for block in (8, 256):
        roots = {r.node: r.root for r in simhash.components(simhash.links(reps, block=block)).collect()}
        classes = {}
        for i, s in enumerate(signed):
            classes.setdefault(roots.get(s, s), []).append(i)
        assert sorted(classes.values()) == sorted([[i for i in want if want[i] == c] for c in set(want.values())])


@pytest.mark.parametrize("widths", [[32, 32], [22, 21, 21], [16] * 4])
def test_thresholds_add_up(widths):
    flat = [np.full(w + 1, 1 / (w + 1)) for w in widths]
    for total in (10, 10**6, 10**10):
        assert sum(simhash.allocate(widths, flat, total, 3)[1]) == 3 - len(widths) + 1


def test_simhash_edges(edge, empty):
    out = simhash.simhash_dedup(edge).collect()
    assert len(out) == len(EDGE) and {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    assert simhash.simhash_dedup(empty).collect() == []


# -- op2 ----------------------------------------------------------------------------


def test_pages_give_their_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.extract(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_template_text_is_dropped(spark):
    page = "<body><div>Site name</div><div><span>Share this</span><p>Story {0} of many</p></div><div>All rights</div></body>"
    rows = [(i, f"https://h.test/{i}", page.format(i), 0, "t") for i in range(12)] + [(99, None, None, 0, "t"), (98, "https://one.test/", "<p>a &lt;b<p>c</p>", 0, "t")]
    out = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()}
    joined = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string"), broadcast_tokens=0)
    assert {r.page_id: r.text for r in joined.collect()} == out
    assert out[3] == "Story 3 of many" and out[99] == "" and out[98] == "a <b\n\nc"


def test_copies_of_a_page_keep_their_article(spark):
    page = "<body><nav>n</nav><article><h1>Same</h1><p>Story of all</p></article><footer>f</footer></body>"
    rows = [(i % 15, "https://h.test/a", page) for i in range(30)] + [(99, "https://h.test/b", page.replace("Same", "Other"))]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 31 and {r.text for r in out if r.page_id != 99} == {"Same\n\nStory of all"}


@pytest.mark.parametrize("page,text", [("", ""), ("<p \"x", ""), ("<script>if(a<b){'</p>'}</script>ok", "ok"), ("<article><ul><li>1<li>2</ul><aside>s</aside><div id='comments'>c</div></article><p>no</p>", "1\n\n2"), ("x<!-- y -->z", "xz")])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


# -- op3 ----------------------------------------------------------------------------


def test_packing_is_whole_and_fits(spark, edge, empty):
    out = packing.best_fit_packing(edge, lengths=(64, 512, 4096)).collect()
    assert sum(r.n_tokens for r in out) == sum(len((t or "").encode()) + 1 for _, t in EDGE)
    bins = {}
    for r in out:
        bins.setdefault((r.bin_id, r.bin_length, r.bin_tokens), []).append(r.n_tokens)
    assert all(sum(v) == used <= size for (_, size, used), v in bins.items())
    assert all(size == min(c for c in (64, 512, 4096) if c >= used) for _, size, used in bins)
    assert packing.best_fit_packing(empty).count() == 0
    where, final = packing.pack([5, 3, 8, 2, 10], (8, 10, 20))
    assert len(set(where)) == len(final) and packing.pack([], (8,)) == ([], [])


# -- op4, op8 ----------------------------------------------------------------------------


def test_language_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert {r.lang_pred for r in langid.identify(edge).collect()} == {"und"} and langid.identify(empty).count() == 0
    model = langid.fit(docs)
    out = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.annotate(edge.where("doc_id IN (1, 2, 3, 9)"), model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[9][0] == "en"
    assert langid.keep_identified(docs).columns == docs.columns


def test_quality_held_out(spark, edge, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    got = quality.quality(some, labels).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("held_out").collect()
    good, bad = ([r for r in got if r.label == k] for k in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.95 and np.mean([1 - r.predicted for r in bad]) > 0.85
    none = labels.where("false")
    assert {r.score for r in quality.quality(edge, none).collect()} == {0.5} and quality.quality(empty, none).count() == 0


# -- op5 ----------------------------------------------------------------------------


@pytest.mark.parametrize("first,growth", [(2, 3), (48, 12)])
def test_exact_dedup_equals_brute_force(edge, empty, first, growth):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in EDGE:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in EDGE:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(edge, first, growth).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_null_ids_alone_are_not_mixed_up(spark):
    rows = spark.createDataFrame([(None, "x" * 60 + c + "y" * 60) for c in "aabb"], "doc_id long, text string")
    assert [r.group_size for r in exact_dedup.exact_dedup(rows).collect()] == [2] * 4


def test_an_id_that_repeats_with_other_texts(spark):
    a, b = "a" * 48, "b" * 48
    rows = [(7, a + "X"), (7, b + "X"), (8, a + "Y"), (9, b + "Y"), (7, a + "X"), (8, b + "X")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, min(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows]
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted(want)


# -- op6 ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def test_pieces_equal_the_library(spark, model, edge, empty, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(1)
    texts = ["", "  ", " a", "  Hello  world\n\tx  é日本 ﬁ"] + ["".join(rng.choice(" aeiou thnrs ▁éñ日ﬁ0123\n\t.-_<>ß😀") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert [i.tolist() for i in model.encode_batch(texts)] == [sp.encode(t) for t in texts]
    assert all(model.decode(sp.encode(t)) == sp.decode(sp.encode(t)) for t in texts)
    monkeypatch.setattr(pieces, "WINDOW", 50)
    assert all(model.encode(t * 4).tolist() == sp.encode(t * 4) for t in texts[:50])
    short = edge.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    out = pieces.encode(short, pieces.default_model())
    assert all(r.same for r in out.collect()) and pieces.encode(empty, pieces.default_model()).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(out, pieces.default_model()).collect()}
    assert back[8] == "Émile 日本 😀 x@y.z" and back[1] == ""


def test_unigram_relaxing_is_the_best_path(model):
    texts = ["the quick brown fox", "aaaa bbbb"]
    model = pieces.load(pieces.default_model())
    model.kind = pieces.UNIGRAM

    def best(word):
        table = [(0.0, ())] + [None] * len(word)
        for t in range(1, len(word) + 1):
            table[t] = max((table[s][0] + model.scores[model.ids[word[s:t]]], (*table[s][1], model.ids[word[s:t]])) for s in range(t) if word[s:t] in model.ids)
        return table[-1]

    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        total = sum(best(w)[0] for w in model.words.findall(model.normalize(text)))
        assert sum(model.scores[i] for i in ids) == total


# -- op7 ----------------------------------------------------------------------------


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (1100, []), (1150, [1.0]), (None, rows[0][1])]
    got = {}
    for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=64, block=3, row=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    usable = {i: np.floor(256 * np.float32(v).astype(np.float64)).astype(int) for i, v in rows[:340]}
    want = {q: sorted(((int(usable[q] @ v), i) for i, v in usable.items() if i != q), key=lambda x: (-x[0], x[1]))[:5] for q in usable if q % 50 == 0}
    assert got == want


# -- op9 ----------------------------------------------------------------------------


def brute_removal(rows, length):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (1 << 63) - 1 if r[0] is None else r[0]):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - length + 1):
            first = seen.setdefault(raw[p : p + length], (i, p))
            if first != (i, p):
                covered[p : p + length] = True
        spans = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(raw, dtype=np.uint8)[~covered].tobytes()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [1, 1024])
def test_suffix_dedup_equals_brute_force(spark, edge, empty, hot):
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(documents(spark), hot=hot).collect()) == brute_removal(rows_of(spark), 100)
    small = edge.where("doc_id IS NULL OR doc_id NOT IN (6, 7)")
    rows = [(i, t) for i, t in EDGE if i not in (6, 7)]
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(small, hot=hot).collect()) == brute_removal(rows, 100)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_rows_that_repeat_an_id(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passage, long = " ".join(words[:60]), " ".join(words)
    rows = [(1, long), (2, "short " + passage), (2, passage[:150]), (2, "x" + long[::-1]), (None, passage), (None, long), (3, None), (3, passage + "é"), (4, "y" * 700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removal([(i, t) for i, t in rows if i not in (2, None)] + [(5, passage)], 100)
    alone = spark.createDataFrame([r for r in rows if r[0] not in (2, None)] + [(5, passage)], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(alone).collect()) == want
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.suffix_dedup(frame).collect()}
    assert len(got) == len(rows) and got[None, len(long)] == len(long) and got[1, len(long)] == 0 == got[2, len(long) + 1]
    data, cut = np.frombuffer(long.encode(), dtype=np.uint8), np.array([500, 520, len(long)])
    whole = [c.tolist() for c in suffix_dedup.runs(data, cut)]
    pieces_ = [suffix_dedup.runs(data[a:b], np.array([b - a])) for a, b in ((0, 500), (500, 520), (520, len(long)))]
    shifted = [[x + a * (c in (1, 2, 3)) for a, p in zip((0, 500, 520), pieces_, strict=True) for x in p[c].tolist()] for c in range(5)]
    assert whole == shifted
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    expanded = lambda r: [(h, a) for h, a, x, y in zip(*(c.tolist() for c in r[:4]), strict=True) for _ in range(y - x + 1)]
    cut_up = expanded(suffix_dedup.runs(data, np.array([len(long)])))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1 << 22)
    assert cut_up == expanded(suffix_dedup.runs(data, np.array([len(long)])))


def test_multikey_groups():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    starts, group = np.arange(400 - 16), rng.integers(0, 2, 400 - 16)
    got = suffix_dedup.multikey_groups(suffix_dedup._words(data), starts, group, 12)
    want = [(group[s], data[s : s + 12].tobytes()) for s in starts]
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))


# -- op10 ----------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * ok
    return out


def test_pii_equals_brute_force(spark, empty):
    extra = [(900_001, "a@b.c_d@x.y 1.2.3.4.5.6.7.8 +1 (23) 456 7890 4111 1111 1111 1111 😀 x@y.z 256.1.1.1 1.1.1.0255"), (900_002, None), (900_003, "1 " * 9000 + "4" * 9000 + "@" * 99 + "a" * 9000), (900_004, "-.-@a.b.c 4111-1111-1111-1111")]
    rows = rows_of(spark) + extra
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, email string")
    want = {i: (brute_spans(t), hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest()) for i, t in rows}
    for r in pii.pii_digest(frame).collect():
        spans, digest = want[r.doc_id]
        assert r.base_sha256 == digest and r.spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]
        assert r.n_card == sum(s.startswith("card") for s in spans)
    assert pii.pii_digest(empty).count() == 0


def test_pii_added_kinds_and_masking(spark):
    rows = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32, GB82WEST12345698765433; 123-45-6789 and social security 123-45-6789", 5), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [s.split(":")[0] for s in pii.pii_digest(rows).where("doc_id = 1").first().spans.split(",")][:1] == ["iban"]
    out = {r.doc_id: r for r in pii.mask_pii(rows).collect()}
    assert out[1].text.startswith("IBAN [IBAN], GB82WEST12345698765433;") and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and pii.mask_pii(rows).columns == rows.columns


def test_pipeline_runs_and_decides(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    texts = dict(rows_of(spark))
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    unique = sorted(first.values())
    grams = {}
    for i in unique:
        words = texts[i].encode().lower().split()
        grams[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    root = {i: i for i in unique}
    for i in unique:
        for j in unique:
            shared = len(grams[i] & grams[j]) if i < j else 0
            if shared and shared >= 0.8 * (len(grams[i]) + len(grams[j]) - shared) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert kept == {i for i in unique if root[i] == i}
