"""The registered queries and their SQL, by name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import redact as R
from ..functions import text as T
from ..functions import urls as U
from ..operators import analysis as AN
from ..operators import findings as FI
from ..operators import ingest as IN
from ..operators import revisions as RV
from ..operators import topics as TP
from ..operators.settled import settle
from ..sources import markup as M
from ..sources.fetch import Response
from ..sources.views import CHECKS, CLAIMS, DOC_REVISIONS, EVIDENCE, FETCH_LOG, HITS, WIRE, table, view, view_of
from ..streaming import articles as SA
from ..streaming import pairs as SP
from ..streaming import revisions as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _joined(column):
    return F.array_join(F.array_sort(column), " ")


# -- SQL building blocks -----------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "]"
_OPPOSITE = "[" + ", ".join(f"'{w}'" for p in V.ANTONYMS for w in p) + "]"


def _ctes(**views: str) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in views.items()) + " "


def _tok(x: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9''-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,}}|\d[\d,]*'), lambda t: lower(t)))"


def _ent(x: str) -> str:
    return rf"list_distinct(list_transform(list_filter(string_split_regex({x}, '[^\pL\pN_]+'), lambda t: regexp_full_match(t, '[A-Z][a-z]{{2,}}')), lambda t: lower(t)))"


def _evt(tok: str, ent: str, more: str = "[]::VARCHAR[]") -> str:
    return rf"list_filter({tok}, lambda t: NOT list_contains({ent}, t) AND NOT list_contains({_STOP}, t) AND NOT list_contains({more}, t) AND NOT regexp_full_match(t, '\d[\d,]*'))"


def _sorted(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({x}), ' '), '')"


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_BASE = r"concat(lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 1)), '://', lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 2)), regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 3))"


def _pair_sql(base: str) -> str:
    """CTEs tok, feat and pairs over a view of revisions."""
    return f"""
tok AS MATERIALIZED (SELECT revision_id, url, title, text, fetched_epoch, {_HOST} AS host, substr({_BASE}, 1, 200) AS safe_url,
  {_tok("concat(title, ' ', text)")} AS dt, {_ent("concat(title, ' ', text)")} AS de, {_tok("text")} AS bt, {_ent("text")} AS be, {_tok("title")} AS tt FROM {base}),
feat AS MATERIALIZED (SELECT revision_id, fetched_epoch, host, safe_url, tt, de, list_filter(de, lambda t: NOT list_contains({_STOP}, t)) AS named,
  {_evt("dt", "de")} AS events, {_evt("bt", "be")} AS body FROM tok),
near AS MATERIALIZED (SELECT l.revision_id AS left_id, r.revision_id AS right_id, l.tt AS ltt, r.tt AS rtt, l.de AS lde, r.de AS rde,
  CASE WHEN l.safe_url = r.safe_url THEN NULL
       WHEN l.host <> r.host AND list_has_any(l.named, r.named) AND len(list_intersect(l.events, r.events)) >= 2 AND len(list_intersect(l.body, r.body)) >= 2 THEN 'high'
       WHEN list_has_any(l.events, r.events) THEN 'possible' END AS confidence
  FROM feat l JOIN feat r ON l.revision_id < r.revision_id AND r.fetched_epoch - l.fetched_epoch BETWEEN -259200 AND 259200),
pairs AS MATERIALIZED (SELECT left_id, right_id, confidence,
  coalesce(nullif(array_to_string(list_slice(list_sort(list_distinct(list_concat(list_intersect(ltt, rtt), list_intersect(lde, rde)))), 1, 5), ' '), ''), 'possible topic') AS label
  FROM near WHERE confidence IS NOT NULL)"""


# -- projections -------------------------------------------------------------------


@query(_ctes(d=DOC_REVISIONS) + r"SELECT revision_id, sha256(nfc_normalize(regexp_replace(title, '\r\n?', chr(10), 'g'))) AS title_sha, sha256(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g'))) AS text_sha FROM d")
def normalized_docs(spark, sf_dir):
    d = view(spark, sf_dir, "doc_revisions")
    return d.select("revision_id", F.sha2(T.normalize(F.col("title")), 256).alias("title_sha"), F.sha2(T.normalize(F.col("text")), 256).alias("text_sha"))


@query(_ctes(d=DOC_REVISIONS) + r"SELECT revision_id, sha256(concat(nfc_normalize(regexp_replace(title, '\r\n?', chr(10), 'g')), chr(10), nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')))) AS content_hash FROM d")
def content_hash(spark, sf_dir):
    d = view(spark, sf_dir, "doc_revisions")
    return d.select("revision_id", T.content_hash(F.col("title"), F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS flat_sha FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("flat_sha"))


@query(f"SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS valid, {_HOST} AS host, substr({_BASE}, 1, 200) AS safe_url, concat({_BASE}, CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN concat('?', regexp_extract(url, '\\?([^#]*)', 1)) ELSE '' END) AS canonical FROM pages")
def page_urls(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.is_http(url).alias("valid"), U.host(url).alias("host"), U.safe(url).alias("safe_url"), U.canonical(url).alias("canonical"))


@query("SELECT page_id, url = trim(url) AND regexp_matches(url, '^(?i:https?)://[^/?#@]+') AS strict FROM pages")
def url_strict(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.strict(F.col("url")).alias("strict"))


@query(r"""
WITH u AS (SELECT event_id, concat('https://usr:pw@h', CAST(user_id AS VARCHAR), '.test/p?page=', CAST(event_id AS VARCHAR), '&api_key=', event_type, '&empty#access_token=', event_type) AS url FROM events)
SELECT event_id, concat('https://', regexp_extract(url, '@([^/]*)/', 1), '/p?page=', CAST(event_id AS VARCHAR), '&api_key=%2A%2A%2A&empty=#access_token=***') AS redacted FROM u
""")
def redact_url(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("https://usr:pw@h"), F.col("user_id").cast("string"), F.lit(".test/p?page="), F.col("event_id").cast("string"), F.lit("&api_key="), F.col("event_type"), F.lit("&empty#access_token="), F.col("event_type"))
    return e.select("event_id", U.redact_url(url).alias("redacted"))


_REDACT = rf"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?im)^[^\r\n:]*?{V.SENSITIVE}[^\r\n:]*:\s*[^\r\n]*', '[redacted]', 'g'),
  '(?i)([?&][^=&#\s]*{V.SENSITIVE}[^=&#\s]*=)[^&#\s]*', '\1[redacted]', 'g'),
  '(?i)(\b{V.SECRET_VALUE}\s*)=\s*[^\s,;&]+', '\1=[redacted]', 'g'),
  '(?i)bearer\s+[^\s,;]+', 'Bearer [redacted]', 'g'), 1, {{limit}})"""


@query(f"SELECT doc_id, sha256({_REDACT.format(limit=2000)}) AS excerpt_sha, sha256({_REDACT.format(limit=500)}) AS error_sha FROM documents")
def redact_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(R.redact(F.col("text")), 256).alias("excerpt_sha"), F.sha2(R.safe_error(F.col("text")), 256).alias("error_sha"))


@query(f"SELECT doc_id, {_sorted(_tok('text'))} AS tokens FROM documents")
def doc_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _joined(T.tokens(F.col("text"))).alias("tokens"))


@query(f"SELECT doc_id, {_sorted(_ent('text'))} AS entities FROM documents")
def doc_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _joined(T.entities(F.col("text"))).alias("entities"))


@query(f"WITH d AS MATERIALIZED (SELECT doc_id, {_tok('text')} AS t, {_ent('text')} AS e FROM documents) SELECT doc_id, {_sorted(_evt('t', 'e'))} AS events FROM d")
def doc_event_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _joined(T.event_tokens(F.col("text"))).alias("events"))


_NUMBERS = r"""num AS MATERIALIZED (SELECT revision_id, CAST(instr(text, phrase) - 1 AS INT) AS start, CAST(instr(text, phrase) - 1 + length(phrase) AS INT) AS "end", phrase,
  regexp_extract(phrase, '^\d+') AS digits, lower(regexp_extract(phrase, '[A-Za-z]+$')) AS unit, string_split(text, '.')[2] AS context
  FROM (SELECT revision_id, text, regexp_extract(text, '\d+ [A-Za-z]+') AS phrase FROM wire) t)"""


@query(_ctes(wire=WIRE)[:-1] + ", " + _NUMBERS + ' SELECT revision_id, start, "end", digits, phrase, unit, context FROM num')
def numeric_claims(spark, sf_dir):
    w = view(spark, sf_dir, "wire")
    return w.select("revision_id", F.explode(T.numeric_claims(F.col("text"))).alias("c")).select("revision_id", "c.*")


@query(_ctes(wire=WIRE) + "SELECT revision_id, string_split(text, '.')[1] AS sentence FROM wire")
def sentence_context(spark, sf_dir):
    w = view(spark, sf_dir, "wire")
    return w.select("revision_id", T.sentence(F.col("text"), F.lit(3), F.lit(5)).alias("sentence"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('article_etag:', event_type) WHEN event_id % 3 = 1 THEN concat('lastmod:', event_type) END AS marker FROM events")
def change_marker(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    etag, lastmod = F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.when(F.col("event_id") % 3 < 2, F.col("event_type"))
    return e.select("event_id", RV.change_marker(etag, lastmod).alias("marker"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.escape_html(F.col("html")).alias("escaped"))


@query("SELECT page_id, lower(url) LIKE '%.xml' OR lower(url) LIKE '%.rss' OR page_id % 5 = 0 AS is_xml FROM pages")
def source_dispatch(spark, sf_dir):
    kind = F.when(F.col("page_id") % 5 == 0, "application/rss+XML; charset=utf-8").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", M.is_xml(kind, F.col("url")).alias("is_xml"))


# -- revision log ------------------------------------------------------------------


@query("SELECT min(event_id) AS id, user_id, max(event_id) AS last_event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def source_upsert(spark, sf_dir):
    return RV.upsert(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(_ctes(f=FETCH_LOG) + "SELECT min(seq) AS id, url, max(seq) AS last_seq, arg_max(source_id, seq) AS source_id, arg_max(content, seq) AS content FROM f GROUP BY url")
def article_latest(spark, sf_dir):
    return RV.upsert(view(spark, sf_dir, "fetch_log").select("url", "seq", "source_id", "content"), "url", "seq")


@query(_ctes(f=FETCH_LOG) + "SELECT url, sha256(arg_max(content, seq)) AS content_hash FROM f GROUP BY url")
def latest_hash(spark, sf_dir):
    return view(spark, sf_dir, "fetch_log").groupBy("url").agg(F.sha2(F.max_by("content", "seq"), 256).alias("content_hash"))


_CHANGES = "ch AS MATERIALIZED (SELECT * FROM (SELECT *, lag(content) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS b FROM f) t WHERE b IS NULL OR b <> content)"


@query(_ctes(f=FETCH_LOG)[:-1] + ", " + _CHANGES + " SELECT url, seq, content, source_id FROM ch")
def revision_changes(spark, sf_dir):
    return RV.changes(view(spark, sf_dir, "fetch_log"), "url", "content", ["fetched_at", "seq"]).select("url", "seq", "content", "source_id")


@query(_ctes(f=FETCH_LOG) + """
, latest AS (SELECT url, arg_max(content, seq) AS stored_marker FROM f WHERE seq % 2 = 0 GROUP BY url)
SELECT f.url, f.seq FROM f LEFT JOIN latest l ON f.url = l.url WHERE f.seq % 2 = 1 AND NOT coalesce(f.content = l.stored_marker AND f.seq % 5 <> 0, false)
""")
def incremental_skip(spark, sf_dir):
    f = view(spark, sf_dir, "fetch_log")
    latest = f.where("seq % 2 = 0").groupBy("url").agg(F.max_by("content", "seq").alias("stored_marker"))
    new = f.where("seq % 2 = 1").select("url", "seq", F.when(F.col("seq") % 5 != 0, F.col("content")).alias("marker"))
    return RV.to_fetch(new, latest).select("url", "seq")


@query(_ctes(d=DOC_REVISIONS) + "SELECT revision_id, url FROM d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.revision_id AND l.quality = 1) ORDER BY revision_id LIMIT 20")
def pending_revisions(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("revision_id"))
    return RV.pending(view(spark, sf_dir, "doc_revisions").select("revision_id", "url"), done)


@query(_ctes(d=DOC_REVISIONS) + "SELECT revision_id, url, fetched_epoch FROM d ORDER BY fetched_epoch DESC, revision_id DESC LIMIT 100")
def recent_context(spark, sf_dir):
    return RV.recent(view(spark, sf_dir, "doc_revisions").select("revision_id", "url", "fetched_epoch"))


@query("SELECT o_orderkey AS revision_id, concat('https://m.test/', CAST(c_custkey AS VARCHAR)) AS url, o_orderstatus AS title, c_name AS article FROM orders JOIN customer ON o_custkey = c_custkey")
def revision_read(spark, sf_dir):
    """Revisions with the address of their article, of which there are fewer."""
    url = F.concat(F.lit("https://m.test/"), F.col("c_custkey").cast("string"))
    articles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id"), url.alias("url"), F.col("c_name").alias("article"))
    revisions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("article_id"), F.col("o_orderstatus").alias("title"))
    return RV.with_articles(revisions, articles).select("revision_id", "url", "title", "article")


@query(_ctes(d=DOC_REVISIONS) + "SELECT l.toxic AS topic_id, d.revision_id, d.url FROM (SELECT DISTINCT toxic, doc_id FROM labels) l JOIN d ON d.revision_id = l.doc_id")
def topic_members(spark, sf_dir):
    links = table(spark, sf_dir, "labels").select(F.col("toxic").alias("topic_id"), F.col("doc_id").alias("revision_id"))
    return RV.link_topics(links.where("false"), links).join(view(spark, sf_dir, "doc_revisions").select("revision_id", "url"), "revision_id").select("topic_id", "revision_id", "url")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_labels(spark, sf_dir):
    return RV.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id").select("doc_id", "quality")


@query(_ctes(c=CHECKS) + "SELECT run_id, count(*) AS sources_checked, CAST(sum(candidates_seen) AS BIGINT) AS candidates_seen, CAST(sum(revisions_created) AS BIGINT) AS revisions_created, CAST(sum(failures) AS BIGINT) AS failures FROM c GROUP BY run_id")
def run_summary(spark, sf_dir):
    return RV.run_summary(view(spark, sf_dir, "checks"))


@query(_ctes(c=CHECKS) + """
SELECT source_id, CASE WHEN failures > 0 THEN 'failed' ELSE 'ok' END AS status, candidates_seen, CASE WHEN error IS NULL THEN NULL ELSE 'token=[redacted] timeout' END AS error
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at DESC, check_id DESC) AS k FROM c) t WHERE k = 1
""")
def source_health(spark, sf_dir):
    out = RV.source_health(view(spark, sf_dir, "checks"))
    return out.select("source_id", "status", "candidates_seen", R.safe_error(F.col("error")).alias("error"))


# -- topics and differences -----------------------------------------------------------


@query(_ctes(wire=WIRE)[:-1] + "," + _pair_sql("wire") + " SELECT left_id, right_id, confidence, label FROM pairs")
def topic_pairs(spark, sf_dir):
    return TP.pairs(view(spark, sf_dir, "wire"))


@query(_ctes(d=DOC_REVISIONS)[:-1] + "," + _pair_sql("d") + " SELECT left_id, right_id, label FROM pairs WHERE confidence = 'high'")
def comparisons(spark, sf_dir):
    return TP.pairs(view(spark, sf_dir, "doc_revisions"), "high").select("left_id", "right_id", "label")


@query(_ctes(wire=WIRE)[:-1] + "," + _pair_sql("wire") + """
SELECT right_id AS revision_id, left_id AS peer_id, label, confidence, CASE WHEN confidence = 'high' THEN 'active' ELSE 'possible' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY confidence <> 'high', left_id) AS k FROM pairs) t WHERE k = 1
""")
def topic_group(spark, sf_dir):
    return TP.best_peers(view(spark, sf_dir, "wire"))


_CONTEXTS = f"""
nset AS MATERIALIZED (SELECT *, {_tok("context")} AS t, {_ent("context")} AS e FROM num),
nfeat AS MATERIALIZED (SELECT *, list_filter(e, lambda t: NOT list_contains({_STOP}, t)) AS named, {_evt("t", "e", "[unit]")} AS events FROM nset),
ndiff AS MATERIALIZED (SELECT left_id, right_id, l.start, l."end", l.phrase AS left_claim, r.phrase AS right_claim FROM pairs
  JOIN nfeat l ON l.revision_id = left_id JOIN nfeat r ON r.revision_id = right_id
  WHERE confidence = 'high' AND l.unit = r.unit AND length(l.digits) <> length(r.digits) AND list_has_any(l.named, r.named) AND len(list_intersect(l.events, r.events)) >= 2)"""
_VERBS = f"""
verb AS MATERIALIZED (SELECT revision_id, word, CAST(instr(text, concat(' ', word, ' ')) AS INT) AS start, CAST(instr(text, concat(' ', word, ' ')) + length(word) AS INT) AS "end", string_split(text, '.')[1] AS context
  FROM (SELECT revision_id, text, split_part(text, ' ', 3) AS word FROM wire) t WHERE word IN ('approved', 'rejected', 'opened', 'closed')),
vset AS MATERIALIZED (SELECT *, {_tok("context")} AS t, {_ent("context")} AS e FROM verb),
vfeat AS MATERIALIZED (SELECT *, list_filter(e, lambda t: NOT list_contains({_STOP}, t)) AS named, {_evt("t", "e", _OPPOSITE)} AS events FROM vset),
odiff AS MATERIALIZED (SELECT left_id, right_id, l.start, l."end", l.word AS left_claim, r.word AS right_claim FROM pairs
  JOIN vfeat l ON l.revision_id = left_id JOIN vfeat r ON r.revision_id = right_id
  WHERE confidence = 'high' AND concat(l.word, ' ', r.word) IN ('approved rejected', 'rejected approved', 'opened closed', 'closed opened')
    AND list_has_any(l.named, r.named) AND list_has_any(l.events, r.events))"""
_WIRE = _ctes(wire=WIRE)[:-1] + "," + _pair_sql("wire") + "," + _NUMBERS + "," + _CONTEXTS + "," + _VERBS


@query(_WIRE + " SELECT * FROM ndiff")
def numeric_differences(spark, sf_dir):
    return TP.numeric_differences(view(spark, sf_dir, "wire"))


@query(_WIRE + " SELECT * FROM odiff")
def opposite_differences(spark, sf_dir):
    return TP.opposite_differences(view(spark, sf_dir, "wire"))


def _all(base: str) -> str:
    """``base`` with its differences numbered by place and worded."""
    return base + f""",
place AS (SELECT revision_id, concat(substr({_BASE}, 1, 200), ' (', {_HOST}, ', ', strftime(make_timestamp(fetched_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ'), ')') AS place FROM wire),
joint AS (SELECT *, 'numeric' AS kind FROM ndiff UNION ALL SELECT o.*, 'opposite' AS kind FROM odiff o ANTI JOIN ndiff n ON o.left_id = n.left_id AND o.right_id = n.right_id),
diff AS MATERIALIZED (SELECT left_id, right_id, kind, start, "end", left_claim, right_claim,
 substr(concat('Material cross-media difference: ', left_claim, ' versus ', right_claim, '; sources: ', l.place, ' vs ', r.place), 1, 500) AS summary,
 substr(concat('cross-media difference ', left_claim, ' versus ', right_claim, '; sources: ', l.place, ' vs ', r.place), 1, 500) AS query
 FROM joint JOIN place l ON l.revision_id = left_id JOIN place r ON r.revision_id = right_id)"""


_ALL = _all(_WIRE)
#: The same from both sides of each pair: a difference belongs to the left revision.
_SIDES = ", sides AS (SELECT left_id, right_id, confidence FROM pairs UNION ALL SELECT right_id, left_id, confidence FROM pairs)"
_BOTH = _all((_ctes(wire=WIRE)[:-1] + "," + _pair_sql("wire") + _SIDES + "," + _NUMBERS + "," + _CONTEXTS + "," + _VERBS).replace("FROM pairs\n", "FROM sides\n"))


@query(_ALL + " SELECT * FROM diff")
def cross_media_differences(spark, sf_dir):
    return TP.differences(view(spark, sf_dir, "wire"))


def _both_sides(w, *peer):
    return TP.differences(w, ordered=False, peer=peer)


@query(_BOTH + " SELECT d.left_id, d.right_id, d.summary, w.url, w.title, w.text AS excerpt, 'retrieved' AS evidence_status, true AS visible FROM diff d JOIN wire w ON w.revision_id = d.right_id")
def pending_analysis_flagship(spark, sf_dir):
    """High pairs from both sides, their differences, the peer as evidence, and what becomes visible."""
    peers = FI.judged_peers(view(spark, sf_dir, "wire"))
    return _both_sides(peers, "peer").select("left_id", "right_id", "summary", "peer.url", "peer.title", "peer.excerpt", "peer.evidence_status", "peer.visible")


def _wire_provider(row: dict) -> str:
    """A made-up provider: claims the third word of a revision; every seventh answer is malformed."""
    ident, text = int(row["revision_id"]), row["text"]
    if ident % 7 == 0:
        return "{}"
    word = text.split(" ")[2]
    span = {"start": text.index(f" {word} ") + 1, "end": text.index(f" {word} ") + 1 + len(word), "materiality": "ordinary" if ident % 3 == 0 else "material"}
    claim = {"text": word, "kind": "checkable", **span}
    candidate = {"finding_type": "factual_contradiction", "summary": "said otherwise", "query": f"notice check {ident}", **span, "materiality": "material"}
    return json.dumps({"revision_id": ident, "claims": [claim], "candidates": [candidate]})


def _wire_search(query: str, limit: int) -> list[tuple]:
    return [(f"https://ev.test/{query.split()[-1]}", "hit", "search", None)]


def _wire_page(url: str) -> Response:
    found = int(url.rsplit("/", 1)[-1]) % 2 == 1
    return Response(200 if found else 404, url, "text/html", b"<article><p>found</p></article>" if found else b"")


_QUEUE = f"""wire AS MATERIALIZED ({WIRE}),
queue AS MATERIALIZED (SELECT * FROM wire WHERE revision_id > (SELECT max(revision_id) - 130 FROM wire) ORDER BY revision_id LIMIT 20),
pool AS MATERIALIZED (SELECT * FROM wire ORDER BY fetched_epoch DESC, revision_id DESC LIMIT 100),
seen AS MATERIALIZED (SELECT * FROM queue UNION SELECT * FROM pool)"""
_PENDING = _all(
    "WITH " + _QUEUE + "," + _pair_sql("seen").replace("l.revision_id < r.revision_id", "l.revision_id <> r.revision_id AND l.revision_id IN (SELECT revision_id FROM queue) AND r.revision_id IN (SELECT revision_id FROM pool)")
    + "," + _NUMBERS.replace("FROM wire", "FROM seen") + "," + _CONTEXTS + "," + _VERBS.replace("FROM wire", "FROM seen")
)
_FOUND = _PENDING + """,
asked AS (SELECT revision_id, CAST(instr(text, concat(' ', split_part(text, ' ', 3), ' ')) AS INT) AS start, CAST(instr(text, concat(' ', split_part(text, ' ', 3), ' ')) + length(split_part(text, ' ', 3)) AS INT) AS "end" FROM queue WHERE revision_id % 7 <> 0),
found AS (SELECT revision_id, CAST(NULL AS BIGINT) AS peer_id, 'factual_contradiction' AS finding_type, 'said otherwise' AS summary, start, "end",
  CASE WHEN revision_id % 2 = 1 THEN 'retrieved' ELSE 'retrieval_failed' END AS evidence_status, false AS visible FROM asked WHERE revision_id % 3 <> 0
  UNION ALL SELECT left_id, right_id, 'material_cross_media_difference', summary, start, "end", 'retrieved', true FROM diff WHERE left_id % 7 <> 0)"""


def _pending_run(spark, sf_dir):
    w = view(spark, sf_dir, "wire")
    last = w.agg(F.max("revision_id").alias("last"))
    done = w.join(last, F.col("revision_id") <= F.col("last") - 130).select("revision_id")
    return AN.run_pending(w, done, _wire_provider, _wire_search, _wire_page)


@query(_PENDING + " SELECT left_id AS revision_id, right_id AS peer_id, label FROM pairs WHERE confidence = 'high'")
def pending_context(spark, sf_dir):
    """The first pending revisions with their high peers among the newest; both limits are the feature."""
    w = view(spark, sf_dir, "wire")
    last = w.agg(F.max("revision_id").alias("last"))
    queue = RV.pending(w, w.join(last, F.col("revision_id") <= F.col("last") - 130))
    return TP.pairs(queue, "high", RV.recent(w)).select(F.col("left_id").alias("revision_id"), F.col("right_id").alias("peer_id"), "label")


@query(_FOUND + ' SELECT revision_id, CAST(peer_id AS VARCHAR) AS peer_id, finding_type, summary, start, "end", evidence_status, visible FROM found')
def pending_analysis(spark, sf_dir):
    """Provider and topic findings of the pending revisions, as one run saves them."""
    return _pending_run(spark, sf_dir).findings.select("revision_id", F.col("peer_id").cast("string").alias("peer_id"), "finding_type", "summary", "start", "end", "evidence_status", "visible")


@query(_FOUND + " SELECT (SELECT count(*) FROM asked) AS claims, count(*) AS candidates, count(*) FILTER (WHERE visible) AS visible_findings, count(*) FILTER (WHERE NOT visible) AS pending, count(*) FILTER (WHERE evidence_status = 'retrieval_failed') AS retrieval_failures FROM found")
def analysis_summary(spark, sf_dir):
    return _pending_run(spark, sf_dir).summary


# -- claims, evidence, findings ---------------------------------------------------------

_VALID = """valid AS MATERIALIZED (SELECT c.*, coalesce(c.start >= 0 AND c.start < c."end" AND c."end" <= length(w.text) AND substr(w.text, c.start + 1, c."end" - c.start) = c.text
  AND length(c.text) BETWEEN 1 AND 2000 AND c.kind IN ('checkable', 'descriptive', 'attributed_statement', 'inference', 'opinion'), false) AS ok FROM claims c LEFT JOIN wire w USING (revision_id))"""


@query(_ctes(wire=WIRE, claims=CLAIMS)[:-1] + "," + _VALID + ' SELECT claim_id, start, "end", kind, ok AS valid FROM valid')
def claim_validity(spark, sf_dir):
    return FI.claim_validity(view(spark, sf_dir, "claims"), view(spark, sf_dir, "wire")).select("claim_id", "start", "end", "kind", "valid")


@query(_ctes(wire=WIRE, claims=CLAIMS)[:-1] + "," + _VALID + """ SELECT claim_id AS candidate_id, claim_id AS claim_by FROM valid
WHERE ok AND materiality = 'material' AND kind NOT IN ('opinion', 'descriptive') AND claim_id % 40 <> 0 AND claim_id % 50 <> 0""")
def material_gate(spark, sf_dir):
    claims = FI.claim_validity(view(spark, sf_dir, "claims"), view(spark, sf_dir, "wire"))
    i = F.col("claim_id")
    candidates = claims.select(
        i.alias("candidate_id"), "revision_id", F.when(i % 20 == 0, i).alias("claim_id"), F.when(i % 40 == 0, "rumour").otherwise("factual_contradiction").alias("finding_type"),
        F.when(i % 50 == 0, " ").otherwise("said otherwise").alias("summary"), "start", "end", F.lit("material").alias("materiality"),
    )
    return FI.material_gate(claims, candidates)


@query('SELECT doc_id % 50 AS revision_id, CAST(length(source) AS INT) AS start, CAST(doc_id % 7 AS INT) AS "end", count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1')
def duplicate_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return FI.duplicate_spans(d.select((F.col("doc_id") % 50).alias("revision_id"), F.length("source").alias("start"), (F.col("doc_id") % 7).cast("int").alias("end")))


@query(_ctes(h=HITS) + f"""
, canon AS (SELECT candidate_id, pos, concat({_BASE}, CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN concat('?', regexp_extract(url, '\\?([^#]*)', 1)) ELSE '' END) AS canonical FROM h),
firsts AS (SELECT candidate_id, canonical, min(pos) AS pos FROM canon GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY pos) AS INT) AS rank FROM firsts) t WHERE rank <= 5""")
def evidence_dedup(spark, sf_dir):
    return FI.dedup_hits(view(spark, sf_dir, "hits"))


@query(_ctes(wire=WIRE) + "SELECT revision_id, CASE WHEN revision_id % 30 = 0 OR revision_id % 70 = 0 THEN '' ELSE concat(title, ' check') END AS query FROM wire")
def evidence_query(spark, sf_dir):
    i = F.col("revision_id")
    asked = F.when(i % 30 == 0, F.lit("token: abc")).when(i % 70 == 0, F.substring("text", 5, 20)).otherwise(F.concat(F.lit("  "), "title", F.lit(" \n check ")))
    return view(spark, sf_dir, "wire").select("revision_id", FI.evidence_query(asked, F.lit(""), F.col("text")).alias("query"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'retrieved' WHEN event_id % 3 = 0 OR event_id % 3 = 1 THEN 'insufficient_scope' ELSE 'retrieval_failed' END AS evidence_status FROM events""")
def evidence_statuses(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "retrieved").when(i % 3 == 1, "oversized").otherwise("timeout")
    return table(spark, sf_dir, "events").select("event_id", FI.evidence_status(status, F.lit("https://a.test/"), F.when(i % 2 == 0, "text").otherwise(" \n")).alias("evidence_status"))


_TYPES = "split_part('factual_contradiction,material_cross_media_difference,unsupported_inference', ',', CAST(user_id % 3 AS INT) + 1)"


@query(_ctes(ev=EVIDENCE) + f"""
, fd AS (SELECT DISTINCT user_id AS finding_id, {_TYPES} AS finding_type FROM events),
fact AS (SELECT finding_id, max(CASE status WHEN 'retrieved' THEN 3 WHEN 'retrieval_failed' THEN 2 WHEN 'insufficient_scope' THEN 1 ELSE 0 END) AS r,
  bool_or(status = 'retrieved' AND relation = 'contradicts') AS against,
  bool_or(status = 'retrieved' AND relation = 'contradicts' AND source_kind = 'related_article' AND url IN ('https://e0.test/x', 'https://e1.test/x')) AS across,
  bool_or(status = 'retrieved' AND source_kind <> 'search') AS grounded FROM ev GROUP BY finding_id),
res AS (SELECT fd.finding_id, finding_type, CASE coalesce(r, 0) WHEN 3 THEN 'retrieved' WHEN 2 THEN 'retrieval_failed' WHEN 1 THEN 'insufficient_scope' ELSE 'pending' END AS evidence_status,
  coalesce(CASE finding_type WHEN 'factual_contradiction' THEN against WHEN 'material_cross_media_difference' THEN across ELSE grounded END, false) AS visible FROM fd LEFT JOIN fact USING (finding_id))
SELECT *, CASE WHEN visible THEN 'resolved' ELSE 'pending' END AS status FROM res""")
def finding_visibility(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.element_at(F.lit(["factual_contradiction", "material_cross_media_difference", "unsupported_inference"]), (F.col("user_id") % 3).cast("int") + 1)
    findings = events.select(F.col("user_id").alias("finding_id"), kind.alias("finding_type")).distinct()
    related = findings.select("finding_id", F.explode(F.lit(["https://E0.test/x#top", "https://e1.test/x"])).alias("url"))
    return FI.resolve(findings, view(spark, sf_dir, "evidence"), related)


@query(_ctes(wire=WIRE)[:-1] + "," + _NUMBERS + """
, cut AS (SELECT w.revision_id, CAST(length(w.text) + 1 AS INT) AS n, num.start AS a, num."end" AS b FROM wire w JOIN num USING (revision_id)),
part AS (SELECT revision_id, unnest([0, a, b, n + a, n + b]) AS start, unnest([a, b, n + a, n + b, 2 * n - 1]) AS "end",
  unnest(['b/pending/open', 'a/retrieved/number|b/pending/open|c/pending/late', 'b/pending/open|c/pending/late', 'a/retrieved/number|b/pending/open|c/pending/late', 'c/pending/late']) AS covered FROM cut)
SELECT revision_id, start, "end", covered FROM part""")
def annotation_segments(spark, sf_dir):
    """Every number of a text said twice, and spans that reach over its ends."""
    w = view(spark, sf_dir, "wire").withColumn("text", F.concat_ws(" ", "text", "text")).withColumn("n", T.numeric_claims(F.col("text")))
    span = lambda a, b, kind, status, summary: F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(summary).alias("summary"))
    numbers = F.transform("n", lambda n: span(n["start"], n["end"], "a", "retrieved", "number"))
    others = F.array(span(F.lit(-5), F.element_at("n", -1)["end"], "b", "pending", "open"), span(F.col("n")[0]["start"], F.lit(99_999), "c", "pending", "late"), span(F.lit(9), F.lit(9), "d", "pending", "empty"))
    return FI.annotation_segments(w.select("revision_id", "text", F.concat(numbers, others).alias("findings")))


@query(_BOTH + """,
spans AS (SELECT DISTINCT left_id AS revision_id, start, "end", concat('material_cross_media_difference/retrieved/', summary) AS name FROM diff),
points AS (SELECT revision_id, start AS a FROM spans UNION SELECT revision_id, "end" FROM spans),
parts AS (SELECT revision_id, a, lead(a) OVER (PARTITION BY revision_id ORDER BY a) AS b FROM points),
marked AS (SELECT p.revision_id, p.a, concat(CAST(p.a AS VARCHAR), '-', CAST(p.b AS VARCHAR), ':', string_agg(s.name, '&' ORDER BY s.name)) AS part
  FROM parts p JOIN spans s ON s.revision_id = p.revision_id AND s.start <= p.a AND s."end" >= p.b GROUP BY p.revision_id, p.a, p.b),
shown AS (SELECT revision_id, count(*) AS n, string_agg(part, '|' ORDER BY a) AS parts FROM marked GROUP BY revision_id),
links AS (SELECT revision_id, string_agg(link, '|' ORDER BY link) AS links FROM (SELECT DISTINCT d.left_id AS revision_id, concat(w.url, ' ', w.title) AS link FROM diff d JOIN wire w ON w.revision_id = d.right_id) t GROUP BY revision_id)
SELECT w.revision_id, w.title, w.host_key AS source, count(d.left_id) AS findings, coalesce(any_value(s.n), 0) AS n_annotations,
  sha256(coalesce(any_value(s.parts), '')) AS annotations_sha, sha256(coalesce(any_value(l.links), '')) AS evidence_sha
FROM wire w LEFT JOIN diff d ON d.left_id = w.revision_id LEFT JOIN shown s ON s.revision_id = w.revision_id LEFT JOIN links l ON l.revision_id = w.revision_id
GROUP BY w.revision_id, w.title, w.host_key""")
def inbox(spark, sf_dir):
    """Revisions with their findings; nested annotations and evidence are told by digests of their text."""
    w = view(spark, sf_dir, "wire")
    found = settle(_both_sides(w), "sides")
    findings = found.select(F.col("left_id").alias("revision_id"), "start", "end", F.lit("material_cross_media_difference").alias("finding_type"), F.lit("retrieved").alias("evidence_status"), "summary")
    evidence = FI.topic_evidence(found.select("left_id", "right_id"), w).withColumnRenamed("left_id", "revision_id")
    rows = FI.inbox(w, findings, evidence)
    names = lambda part: F.array_join(F.transform(part["covered"], lambda f: F.concat_ws("/", f["type"], f["status"], f["summary"])), "&")
    parts = F.array_join(F.transform("annotations", lambda p: F.concat(p["start"].cast("string"), F.lit("-"), p["end"].cast("string"), F.lit(":"), names(p))), "|")
    links = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["url"], e["title"])), "|")
    return rows.select("revision_id", "title", F.col("host_key").alias("source"), "findings", F.size("annotations").cast("long").alias("n_annotations"), F.sha2(parts, 256).alias("annotations_sha"), F.sha2(links, 256).alias("evidence_sha"))


@query(_BOTH + " SELECT 'Material cross-media difference' AS finding, 'Evidence retrieved' AS evidence, summary, w.url AS href, w.title AS link_title, 'related_revision' AS details FROM diff d JOIN wire w ON w.revision_id = d.right_id")
def findings_view(spark, sf_dir):
    peers = FI.judged_peers(view(spark, sf_dir, "wire"))
    link = AN.evidence_link(F.col("peer.url"), F.col("peer.title"), F.col("peer.provider"), F.lit(None).cast("string"))
    shown = peers.withColumn("peer", F.struct("peer.evidence_status", "peer.visible", link.alias("l")))
    rows = _both_sides(shown, "peer").where("peer.visible")
    labels = R.label(F.lit("material_cross_media_difference"), V.FINDING_LABELS).alias("finding"), R.label(F.col("peer.evidence_status"), V.STATUS_LABELS).alias("evidence")
    return rows.select(*labels, "summary", "peer.l.href", F.col("peer.l.title").alias("link_title"), "peer.l.details")


# -- markup ---------------------------------------------------------------------------


def _sql_replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


_DROPS = [(f"(?is)<{t}\\b.*?</{t}\\s*>", "''") for t in sorted(M.DROPPED)]
_UNESCAPED = [("&quot;?", "chr(34)"), ("&amp;?", "'&'"), (r"\s+", "' '")]
_BLOCKS = _sql_replaced("html", *_DROPS, ("(?s)<!--.*?-->", "''"), (r"(?i)<(h[1-6]|li|p)(\s[^>]*)?>", "chr(1)"), (r"(?i)</(h[1-6]|li|p)\s*>", "chr(2)"), ("<[^>]*>", "''"))


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all({_BLOCKS}, '\x01([^\x01\x02]*)\x02', 1), lambda b: trim({_sql_replaced('b', *_UNESCAPED)})), lambda b: b <> ''), chr(10)) AS text FROM pages")
def page_text(spark, sf_dir):
    return M.articles(table(spark, sf_dir, "pages")).select("page_id", "text")


@query(r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), 1, 500) AS title FROM pages""")
def page_title(spark, sf_dir):
    return M.articles(table(spark, sf_dir, "pages")).select("page_id", "title")


@query(f"""
SELECT url AS source_url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY nr) - 1 AS INT) AS pos,
       concat(regexp_extract(url, '^https?://[^/?#]*'), regexp_extract(link, 'href="([^"]*)"', 1)) AS url, title, CAST(NULL AS VARCHAR) AS published_at, CAST(NULL AS VARCHAR) AS lastmod
FROM (SELECT *, trim({_sql_replaced("regexp_extract(link, '>([^<]*)<', 1)", *_UNESCAPED)}) AS title
      FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS link, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS nr FROM pages) t) u
WHERE title <> ''
""")
def html_list_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("url", F.lit("text/html").alias("content_type"), F.encode(F.replace(F.col("html"), F.lit("nav>"), F.lit("section>")), "UTF-8").alias("body"))
    return M.candidates(pages)  # the pages' only anchors stand in navigation, which list pages ignore


def _feed(spark, sf_dir, head, items, tail):
    """Feeds of several entries; one in ten ends before its end."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    end = F.when(F.col("page_id") % 10 == 3, "").otherwise(tail)
    body = F.concat(F.lit(head), F.format_string(items, F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.col("page_id")), end)
    return M.candidates(rows.select(F.format_string("https://f.test/%d.xml", "page_id").alias("url"), F.lit("application/xml").alias("content_type"), body.alias("body")))


def _feed_sql(*entries: tuple[str, str, str, str]) -> str:
    """Rows of entries (url, title, published_at, lastmod) of every page's feed."""
    one = "SELECT concat('https://f.test/', CAST(page_id AS VARCHAR), '.xml') AS source_url, CAST({} AS INT) AS pos, {} AS url, {} AS title, {} AS published_at, {} AS lastmod FROM pages WHERE page_id % 10 <> 3"
    return " UNION ALL ".join(one.format(k, *e) for k, e in enumerate(entries))


_NONE, _PAGE = "CAST(NULL AS VARCHAR)", "CAST(page_id AS VARCHAR)"


@query(_feed_sql(("url", f"concat('Item ', {_PAGE})", "'2024-01-01'", _NONE), ("concat(url, '#b')", "'A & B'", "'D'", _NONE), ("'https://c.test/'", "''", _NONE, _NONE)))
def feed_rss(spark, sf_dir):
    items = (
        "<item><title>x</title><link>%1$s</link><title>Item %2$d</title><pubDate>2024-01-01</pubDate></item><item><link>mailto:a</link></item><item><title>no link</title></item>"
        "<other><item><link>https://no.test/</link></item></other><item><link>%1$s#b</link><title> A &amp;\n B </title><x:date xmlns:x='u'>D</x:date></item><item><link>https://c.test/</link></item>"
    )
    return _feed(spark, sf_dir, "<rss><channel>", items, "</channel></rss>")


@query(_feed_sql(("url", f"concat('Entry ', {_PAGE})", "'2024-01-02'", _NONE), ("concat(url, '#b')", "'B'", "'P'", _NONE)))
def feed_atom(spark, sf_dir):
    entries = (
        '<entry><link rel="self" href="https://no.test/"/><link href="%1$s"/><title>Entry %2$d</title><updated>2024-01-02</updated></entry><entry><link href="/relative"/></entry><entry><title>no link</title></entry>'
        '<entry><link rel="alternate" href="%1$s#b"/><link href="https://second.test/"/><title>B</title><published>P</published><updated>U</updated></entry>'
    )
    return _feed(spark, sf_dir, '<feed xmlns="http://www.w3.org/2005/Atom">', entries, "</feed>")


@query(_feed_sql(("url", "''", f"concat('2024-', {_PAGE})", f"concat('2024-', {_PAGE})"), ("concat(url, '#b')", "''", _NONE, _NONE)))
def feed_sitemap(spark, sf_dir):
    entries = "<url><loc>%1$s</loc><lastmod>2024-%2$d</lastmod></url><url><loc>ftp://a.test/</loc></url><url><lastmod>1</lastmod></url><sitemap><loc>https://no.test/</loc></sitemap><url><loc> %1$s#b </loc></url>"
    return _feed(spark, sf_dir, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', entries, "</urlset>")


# -- polling -----------------------------------------------------------------------


def _newsroom(url: str) -> Response:
    """A made-up site: a sitemap of four articles, whose last one is lost for every third number."""
    number, page = url.removeprefix("https://s").split(".test/")
    if page == "map.xml":
        entries = "".join(f"<url><loc>https://s{number}.test/{k}</loc><lastmod>2024-01-0{k}</lastmod></url>" for k in range(1, 5))
        return Response(200, url, "application/xml", f"<urlset>{entries}</urlset>".encode())
    lost = page == "4" and int(number) % 3 == 0
    return Response(404 if lost else 200, url, "text/html", f"<article><p>Report {page} of {number}</p></article>".encode())


@query("""
SELECT source_id, CASE WHEN lost = 1 THEN 'failed' ELSE 'ok' END AS status, CAST(4 AS BIGINT) AS candidates_seen,
       CAST(4 - known - lost AS BIGINT) AS revisions_created, CAST(lost AS BIGINT) AS failures,
       CASE WHEN lost = 1 THEN 'article http_error' END AS error
FROM (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS known, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS lost
      FROM supplier WHERE s_suppkey % 5 <> 0) t
""")
def watch_batch(spark, sf_dir):
    number = F.col("s_suppkey").cast("string")
    suppliers = table(spark, sf_dir, "supplier")
    sources = suppliers.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://s"), number, F.lit(".test/map.xml")).alias("feed_url"), (F.col("s_suppkey") % 5 != 0).alias("enabled"))
    latest = suppliers.where("s_suppkey % 2 = 0").select(F.concat(F.lit("https://s"), number, F.lit(".test/1")).alias("url"), F.lit("h").alias("content_hash"), F.lit("lastmod:2024-01-01").alias("marker"))
    return IN.poll(sources, latest, _newsroom, F.timestamp_seconds(F.lit(1704067200))).checks.drop("checked_at")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 28800 WHEN event_id % 3 = 2 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) ELSE -1 END AS published_epoch
FROM events
""")
def published_times(spark, sf_dir):
    zone = F.when(F.col("event_id") % 3 == 1, "+08:00").when(F.col("event_id") % 3 == 2, "Z").otherwise("")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_timestamp(IN.published_utc(text)), F.lit(-1)).alias("published_epoch"))


@query(r"""
SELECT page_id, CASE WHEN length(v) > 200 OR regexp_matches(v, '(?i)(?:bearer\s+\S+|["'']?(?:authorization|cookie|token|secret|password|session|api[-_]key|access[_-]?token)["'']?\s*[:=])') THEN '' ELSE v END AS shown
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('token=', url) WHEN 1 THEN repeat(url, 9) ELSE url END AS v FROM pages) t
""")
def shown_metadata(spark, sf_dir):
    value = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("token="), "url")).when(F.col("page_id") % 4 == 1, F.repeat("url", 9)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", AN.safe_metadata(value).alias("shown"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('https://e.test/', CAST(event_id AS VARCHAR), '?q=', event_type) END AS href,
       CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'Evidence' ELSE concat('A &amp; ', event_type) END AS title,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('search · ', CAST(user_id AS VARCHAR)) END AS details
FROM events
""")
def evidence_links(spark, sf_dir):
    n = F.col("event_id") % 4
    url = F.concat(F.lit("https://e.test/"), F.col("event_id").cast("string"), F.lit("?q="), F.when(n == 0, F.lit("to%25256ben%253D")).otherwise(""), F.col("event_type"))
    title = F.when(n == 1, F.lit("password: x")).otherwise(F.concat(F.lit("A & "), "event_type"))
    link = AN.evidence_link(url, title, F.lit("search"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", link.alias("l")).select("event_id", "l.href", "l.title", "l.details")


@query("SELECT u.url, max_by(a.event_type, a.event_id) AS metadata FROM (SELECT DISTINCT concat('u', CAST(user_id % 500 AS VARCHAR)) AS url FROM events) u LEFT JOIN events a ON u.url = concat('u', CAST(a.user_id AS VARCHAR)) AND a.user_id % 2 = 0 GROUP BY u.url")
def article_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = lambda i: F.concat(F.lit("u"), i.cast("string")).alias("url")
    known = e.where("user_id % 2 = 0").select(name(F.col("user_id")), "event_id", F.col("event_type").alias("metadata"))
    return RV.metadata_of(RV.upsert(known, "url", "event_id"), e.select(name(F.col("user_id") % 500)))


@query("SELECT count(*) AS sources, count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS enabled FROM supplier")
def source_count(spark, sf_dir):
    return RV.source_counts(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5 != 0).alias("enabled")))


@query("""
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 28800 WHEN 2 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) ELSE CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS VARCHAR) AS epoch
FROM events
""")
def lenient_times(spark, sf_dir):
    """Times with a zone, without one, days alone, and what is no ISO time."""
    n = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n == 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).when(n == 1, F.concat(stamp, F.lit("+08:00"))).when(n == 2, stamp).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(IN.lenient_utc(text)).cast("string").alias("epoch"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS reader, event_id % 5 <> 0 AS known FROM events")
def metadata_map(spark, sf_dir):
    """Stored metadata as a map; one row in five holds something else."""
    stored = F.to_json(F.create_map(F.lit("kind"), "event_type", F.lit("reader"), F.col("user_id").cast("string")))
    found = RV.metadata_map(F.when(F.col("event_id") % 5 == 0, F.lit("[1]")).otherwise(stored))
    return table(spark, sf_dir, "events").select("event_id", found.alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["reader"].alias("reader"), F.col("m").isNotNull().alias("known"))


# -- streams ------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """A table, one file or a folder of them, as a stream of its files; a pattern may name either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""
WITH e AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS url, event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN concat('m', CAST(event_id // 16 % 2 AS VARCHAR)) END AS marker,
  CASE WHEN event_id % 3 <> 0 THEN event_type END AS content FROM events),
b AS (SELECT *, last_value(content IGNORE NULLS) OVER w AS known, last_value(CASE WHEN content IS NOT NULL THEN marker END IGNORE NULLS) OVER w AS stored
  FROM e WINDOW w AS (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT url, seq, CASE WHEN content IS NULL AND known IS NOT NULL AND marker = stored THEN 'skip' WHEN content IS NULL THEN 'fetch' WHEN content = known THEN 'unchanged' ELSE 'revision' END AS decision
FROM b
""")
def article_states(spark, sf_dir):
    """Sightings and readings of articles as a stream with a hash and a marker an address."""
    n = F.col("event_id")
    events = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), n.alias("seq"), F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(n % 7 != 0, F.concat(F.lit("m"), (F.floor(n / 16) % 2).cast("string"))).alias("marker"), F.when(n % 3 != 0, F.col("event_type")).alias("content_hash"),
    )
    with SA.rocksdb(spark):
        return ST.finished(SA.article_stream(events), "article-states").select("url", "seq", "decision")


@query(_ctes(wire=WIRE) + "SELECT l.revision_id AS left_id, r.revision_id AS right_id FROM wire l JOIN wire r ON l.revision_id < r.revision_id AND r.fetched_epoch - l.fetched_epoch <= 21600 AND r.fetched_epoch >= l.fetched_epoch")
def near_revisions_stream(spark, sf_dir):
    """Revisions at most six hours apart, from two streams of them."""
    wire = lambda: view_of(spark, "wire", _stream(spark, sf_dir, "orders")).select("revision_id", F.timestamp_seconds("fetched_epoch").alias("fetched_at"))
    return ST.finished(SP.window_pairs_stream(wire(), wire(), 21_600), "near-revisions")
