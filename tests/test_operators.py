"""Revision log, topic pairs, differences, findings, annotation, readers and streaming."""

from pyspark.sql import functions as F

from pressdelta.operators import findings as FI
from pressdelta.operators import revisions as RV
from pressdelta.operators import topics as TP
from pressdelta.sources import markup as M
from pressdelta.streaming import revisions as S

BASE = 1_700_000_000
SCHEMA = "revision_id long, url string, title string, text string, fetched_epoch long"


def revisions(spark, *rows):
    return spark.createDataFrame([(i + 1, url, title, text, BASE + hours * 3600) for i, (url, title, text, hours) in enumerate(rows)], SCHEMA)


def confidences(spark, *rows):
    return [r.confidence for r in TP.pairs(revisions(spark, *rows)).collect()]


A = ("https://a.test/1", "Taipei permit vote", "Taipei Council approved the coastal permit after review.", 0)
B = ("https://b.test/1", "Taipei permit vote", "Taipei Council rejected the coastal permit after review.", 5)


def test_pair_confidence(spark):
    assert confidences(spark, A, B) == ["high"]
    assert confidences(spark, A, ("https://a.test/2", *B[1:])) == ["possible"]
    assert confidences(spark, A, (A[0] + "?page=2", *B[1:])) == []
    assert confidences(spark, A, (*B[:3], 73)) == [] and confidences(spark, A, (*B[:3], 72)) == ["high"]
    assert confidences(spark, A, ("https://u:p@b.test/1", *B[1:])) == []


def test_opposite_and_numeric_differences(spark):
    found = TP.differences(revisions(spark, A, B)).collect()
    assert [(d.kind, d.left_claim, d.right_claim, A[2][d.start : d.end]) for d in found] == [("opposite", "approved", "rejected", "approved")]
    n = lambda k, host: (f"https://{host}.test/1", "Taipei exercise", f"Taipei Ministry deployed {k} troops near the coastal harbour.", 1)
    assert [(d.kind, d.left_claim, d.right_claim) for d in TP.differences(revisions(spark, n(100, "a"), n("1,000", "b"))).collect()] == [("numeric", "100 troops", "1,000 troops")]
    assert TP.differences(revisions(spark, n(450, "a"), n(520, "b"))).count() == 0
    reopened = ("https://b.test/1", A[1], A[2].replace("approved", "reopened"), 1)
    assert TP.differences(revisions(spark, (A[0], A[1], A[2].replace("approved", "closed"), 0), reopened)).count() == 0


def test_window_pairs_equal_brute_force(spark):
    rows = spark.range(60).select(F.col("id").alias("revision_id"), (F.lit(BASE) + F.col("id") * F.col("id") * 997 % 900_000).alias("fetched_epoch"))
    got = {(r[0], r[1]) for r in TP.window_pairs(rows, rows).select("l.revision_id", "r.revision_id").collect()}
    data = [tuple(r) for r in rows.collect()]
    assert got == {(a, c) for a, b in data for c, d in data if a < c and abs(b - d) <= 72 * 3600}


def test_revision_log_keeps_a_b_a(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "a"), ("v", 5, None), ("v", 6, None)], "url string, seq long, hash string")
    assert sorted(r.seq for r in RV.changes(rows, "url", "hash", ["seq"]).collect()) == [1, 3, 4, 5, 6]
    last = RV.upsert(rows, "url", "seq").where("url = 'u'").first()
    assert (last.id, last.last_seq, last.hash) == (1, 4, "a")


def test_skip_pending_and_links(spark):
    new = spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", None), ("d", "m")], "url string, marker string")
    old = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", "m1")], "url string, stored_marker string")
    assert sorted(r.url for r in RV.to_fetch(new, old).collect()) == ["b", "c", "d"]
    rows = spark.range(5).withColumnRenamed("id", "revision_id")
    assert [r[0] for r in RV.pending(rows, rows.where("revision_id = 1"), 2).collect()] == [0, 2]
    links = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "topic_id long, revision_id long")
    assert RV.link_topics(links, links).count() == 2
    sources = spark.createDataFrame([(1, "f", "l", True)], "id long, feed_url string, article_url string, enabled boolean")
    assert [r.feed_url for r in RV.add_once(sources, spark.createDataFrame([("f",), ("l",), ("n",)], "feed_url string")).collect()] == ["n"]
    assert RV.set_enabled(sources, 1, False).first().enabled is False


def test_claims_and_gate(spark):
    article = spark.createDataFrame([(1, "abc def")], "revision_id long, text string")
    claims = spark.createDataFrame([(1, 1, "abc", 0, 3, "checkable", "material", "extracted"), (2, 1, "abd", 0, 3, "checkable", "material", "extracted"), (3, 1, "def", 4, 7, "opinion", "material", "extracted"), (4, 9, "x", 0, 1, "checkable", "material", "extracted")], "claim_id long, revision_id long, text string, start int, end int, kind string, materiality string, extraction_status string")
    valid = FI.claim_validity(claims, article)
    assert {r.claim_id for r in valid.where("valid").collect()} == {1, 3}
    assert [(r.start, r.n) for r in FI.duplicate_spans(claims).collect()] == [(0, 2)]
    candidates = spark.createDataFrame([(10, 1, None, "factual_contradiction", "s", 0, 3, "material"), (11, 1, None, "factual_contradiction", "s", 4, 7, "material"), (12, 1, 5, "factual_contradiction", "s", 0, 3, "material")], "candidate_id long, revision_id long, claim_id long, finding_type string, summary string, start int, end int, materiality string")
    assert [(r.candidate_id, r.claim_by) for r in FI.material_gate(valid, candidates).collect()] == [(10, 1)]


def test_resolution_flat_and_nested_agree(spark):
    kinds = ["factual_contradiction", "material_cross_media_difference", "unsupported_inference"]
    findings = spark.createDataFrame([(i, kinds[i % 3]) for i in range(12)], "finding_id long, finding_type string")
    rows = [(i, "https://P.test/x#f", "text", r, s, k) for i in range(9) for r, s, k in [(("contradicts", "context")[i % 2], ("retrieved", "retrieval_failed", "insufficient_scope")[i // 3], ("related_article", "search")[i % 4 == 3])]]
    schema = "finding_id long, url string, excerpt string, relation string, status string, source_kind string"
    evidence = spark.createDataFrame(rows, schema)
    related = findings.select("finding_id", F.lit("https://p.test/x").alias("url"))
    flat = {r.finding_id: (r.evidence_status, r.visible, r.status) for r in FI.resolve(findings, evidence, related).collect()}
    nested = findings.join(evidence.groupBy("finding_id").agg(F.collect_list(F.struct("url", "excerpt", "relation", "status", "source_kind")).alias("evidence")), "finding_id", "left")
    nested = nested.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<url:string,excerpt:string,relation:string,status:string,source_kind:string>>"))).withColumn("related", F.array(F.lit("https://p.test/x")))
    assert flat == {r.finding_id: (r.evidence_status, r.visible, r.status) for r in FI.resolve_nested(nested).collect()}
    assert flat[11] == ("pending", False, "pending") and flat[0][1]


def test_segments_cover_the_text_once(spark):
    spans = "array<struct<start:int,end:int,type:string,status:string,summary:string>>"
    rows = spark.createDataFrame([(1, "hello world", [(-3, 5, "b", "p", "x"), (3, 99, "a", "r", "y"), (4, 4, "c", "p", "z")]), (2, "", [])], f"revision_id long, text string, findings {spans}")
    out = sorted((r.start, r.end, r.covered) for r in FI.annotation_segments(rows).collect())
    assert out == [(0, 3, "b/p/x"), (3, 5, "a/r/y|b/p/x"), (5, 11, "a/r/y")]


def test_evidence_rules(spark):
    row = spark.createDataFrame([("token: x", "s", "body"), (None, "part of", "a part of b"), (" why  now ", "s", "body")], "q string, s string, a string")
    assert [r[0] for r in row.select(FI.evidence_query(F.col("q"), F.col("s"), F.col("a"))).collect()] == ["", "", "why now"]
    hits = spark.createDataFrame([(1, 1, "https://a.test/x#1"), (1, 2, "https://A.test/x"), (1, 3, "bad"), (1, 4, "https://b.test/")], "candidate_id long, pos long, url string")
    assert sorted(r.pos for r in FI.dedup_hits(hits, 5).collect()) == [1, 4]
    assert [r.pos for r in FI.dedup_hits(hits, 0).collect()] == [1]
    stored = FI.store_evidence(spark.createDataFrame([("https://a.test/?token=q", "T", "password=1", "retrieved", "ok"), ("https://a.test/", "T", "e", "retrieval_failed", "no good")], "url string, title string, excerpt string, status string, provider string")).collect()
    assert "q" not in stored[0].url.split("token=")[1] and stored[0].excerpt == "password=[redacted]"
    assert (stored[1].title, stored[1].excerpt, stored[1].provider) == ("Evidence retrieval_failed", "", None)


def test_readers():
    rss = b"<rss><channel><item><title>a</title><link>https://x.test/1</link><pubDate>P</pubDate></item><other><item><link>https://no/</link></item></other></channel></rss>"
    assert list(M.parse_feed(rss, "https://s.test/")) == [("https://x.test/1", "a", "P", None)]
    assert list(M.parse_feed(b"<broken", "")) == [] and list(M.parse_sitemap(b"<sitemapindex/>", "")) == []
    links = b"<nav><a href='/n'>n</a></nav><li><a href='/a'>A <b>b</b></a><time datetime='T'></time></li><a href='/e'></a>"
    assert list(M.parse_links(links, "https://s.test/x/")) == [("https://s.test/a", "A b", "T", None)]
    page = b"<title> T  t</title><article><h1>H</h1>loose <p>one<p>two</p><nav><p>no</p></nav></article><div>out</div>"
    assert M.read_article(page) == ("T t", "H\nloose\ntwo")
    assert M.read_article(page, "application/pdf") == ("", "") and M.read_article(b"x" * 1_000_001) == ("", "")
    assert M.decode_body(b"\xe9", None) == "é" and M.decode_body(b"\xef\xbb\xbfa", None) == "a"


def test_candidates_cap_and_dispatch(spark):
    body = "<rss><channel>" + "".join(f"<item><link>https://x.test/{i}</link></item>" for i in range(9)) + "</channel></rss>"
    rows = spark.createDataFrame([("https://s.test/f.xml", "text/plain", body.encode()), ("https://s.test/l", "text/html", b"<a href='/q'>q</a>"), ("https://s.test/n", "text/html", None)], "url string, content_type string, body binary")
    out = M.candidates(rows, limit=4).collect()
    assert sorted((r.source_url, r.pos) for r in out) == [("https://s.test/f.xml", i) for i in range(4)] + [("https://s.test/l", 0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i % 3}", i, i, f"h{i // 4 % 2}") for i in range(40)], "url string, seq long, t long, content_hash string").withColumn("fetched_at", F.timestamp_seconds("t"))
    for k in range(2):
        rows.where(f"seq % 2 = {k} OR seq < 4").where(f"seq {'<' if k == 0 else '>='} 20 OR seq < 4").unionByName(rows.where(f"seq {'<' if k == 0 else '>='} 20")).distinct().write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    S.run_available(S.revision_stream(stream), str(tmp_path / "cp"), S.append_once(str(tmp_path / "out")))
    got = {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.seq for r in RV.changes(rows, "url", "content_hash", ["fetched_at", "seq"]).collect()}


def test_annotations_nest_all_findings_of_a_revision(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, "none"), (3, "")], "revision_id long, text string")
    rows = [(1, -3, 5, "b", "p", "x"), (1, 3, 99, "a", "r", "y"), (1, 3, 5, "a", "p", "z"), (1, 3, 5, "a", "p", "z"), (1, 7, 7, "c", "p", "w"), (3, 0, 4, "a", "p", "q"), (9, 0, 1, "a", "p", "lost")]
    found = spark.createDataFrame(rows, "revision_id long, start int, end int, finding_type string, evidence_status string, summary string")
    out = {r.revision_id: [(a.start, a.end, [tuple(c) for c in a.covered]) for a in r.annotations] for r in FI.annotations(found, texts).collect()}
    assert out == {1: [(0, 3, [("b", "p", "x")]), (3, 5, [("a", "p", "z"), ("a", "r", "y"), ("b", "p", "x")]), (5, 11, [("a", "r", "y")])]}
    links = spark.createDataFrame([(1, "u", "T"), (1, "u", "T"), (1, "t", "S")], "revision_id long, url string, title string")
    shown = {r.revision_id: (r.findings, len(r.annotations), [e.url for e in r.evidence]) for r in FI.inbox(texts, found, links).collect()}
    assert shown == {1: (5, 3, ["t", "u"]), 2: (0, 0, []), 3: (1, 0, [])}
