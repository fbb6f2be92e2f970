"""Views that give the driver's tables the shape of revisions, fetches and claims.

Each is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOC_REVISIONS = """
SELECT doc_id AS revision_id, doc_id AS article_id, source AS host_key,
       concat('https://', source, '.test/doc/', CAST(doc_id AS VARCHAR(20))) AS url,
       substr(split_part(text, chr(10), 1), 1, 120) AS title, text,
       1704067200 + doc_id * 5820 AS fetched_epoch
FROM documents
"""

WIRE = """
SELECT o_orderkey AS revision_id, o_orderkey AS article_id,
       concat('m', CAST(o_custkey % 7 AS VARCHAR(20))) AS host_key,
       concat('https://m', CAST(o_custkey % 7 AS VARCHAR(20)), '.test/n/', CAST(o_orderkey AS VARCHAR(20))) AS url,
       concat(city, ' ', place, ' notice') AS title,
       concat(city, ' ', agency, ' ', verb, ' the ', place, ' ', doc, '. ', city, ' ', agency, ' reports ',
              CAST(amount AS VARCHAR(20)), ' ', unit, ' ', verb2, ' at the ', place, ' ', act, '.') AS text,
       1704067200 + o_orderkey * 6000 AS fetched_epoch
FROM (SELECT o_orderkey, o_custkey,
        split_part('Taipei,Tainan,Hualien,Keelung,Yilan,Miaoli,Penghu,Chiayi,Nantou,Taitung,Pingtung', ',', CAST(j % 11 AS INT) + 1) AS city,
        split_part('coastal,airport,harbour,railway,hospital', ',', CAST(j % 5 AS INT) + 1) AS place,
        split_part('permit,budget,contract', ',', CAST(j % 3 AS INT) + 1) AS doc,
        split_part('exercise,inspection,upgrade', ',', CAST(j % 3 AS INT) + 1) AS act,
        split_part('workers,vessels,patients', ',', CAST(j % 3 AS INT) + 1) AS unit,
        split_part('Ministry,Council,Bureau,Agency', ',', CAST(j % 4 AS INT) + 1) AS agency,
        split_part('deployed,assigned', ',', CAST(j % 2 AS INT) + 1) AS verb2,
        split_part('approved,rejected,opened,closed,delayed,funded', ',', CAST(o_custkey % 6 AS INT) + 1) AS verb,
        CAST((j % 9 + 1) * pow(10, o_custkey % 4 + 1) AS BIGINT) AS amount
      FROM (SELECT o_orderkey, o_custkey, o_orderkey AS j FROM orders) t) u
"""

FETCH_LOG = """
SELECT event_id AS seq, user_id % 7 AS source_id,
       concat('https://m', CAST(user_id % 7 AS VARCHAR(20)), '.test/u/', CAST(user_id AS VARCHAR(20))) AS url,
       ts AS fetched_at, event_type AS content
FROM events
"""

CLAIMS = """
SELECT revision_id AS claim_id, revision_id, split_part(text, ' ', 3) AS text,
       CAST(instr(text, concat(' ', split_part(text, ' ', 3), ' ')) AS INT) AS start,
       CAST(instr(text, concat(' ', split_part(text, ' ', 3), ' ')) + length(split_part(text, ' ', 3)) - CASE WHEN revision_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS "end",
       split_part('checkable,descriptive,attributed_statement,inference,opinion,rumour', ',', CAST(revision_id % 6 AS INT) + 1) AS kind,
       CASE WHEN revision_id % 3 = 0 THEN 'ordinary' ELSE 'material' END AS materiality,
       'extracted' AS extraction_status
FROM wire
"""

HITS = """
SELECT page_id % 20 AS candidate_id, page_id AS pos, url FROM pages
"""

CHECKS = """
SELECT event_id AS check_id, event_id % 50 AS run_id, user_id AS source_id, ts AS checked_at,
       user_id % 9 AS candidates_seen, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS revisions_created,
       CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS failures,
       CASE WHEN event_id % 11 = 0 THEN concat('token=', event_type, ' timeout') END AS error
FROM events
"""

EVIDENCE = """
SELECT user_id AS finding_id, concat('https://e', CAST(event_id % 5 AS VARCHAR(20)), '.test/x') AS url, event_type AS excerpt,
       CASE WHEN event_id % 3 = 0 THEN 'contradicts' ELSE 'context' END AS relation,
       CASE WHEN (user_id + event_id) % 4 = 0 THEN 'retrieved' WHEN user_id % 3 = 0 THEN 'retrieval_failed' WHEN user_id % 3 = 1 THEN 'insufficient_scope' ELSE 'pending' END AS status,
       CASE WHEN event_id % 2 = 0 THEN 'related_article' ELSE 'search' END AS source_kind
FROM events
"""

_VIEWS = {"wire": WIRE, "doc_revisions": DOC_REVISIONS, "fetch_log": FETCH_LOG, "claims": CLAIMS, "hits": HITS, "checks": CHECKS, "evidence": EVIDENCE}


_SOURCES = {"wire": "orders", "doc_revisions": "documents", "hits": "pages", "claims": "orders"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that scans in fewer tasks than half of the cores is dealt over all of them.

    A small file is one task however long its texts take. Tables of many files stay as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``."""
    return view_of(spark, name, table(spark, sf_dir, _SOURCES.get(name, "events")))


def view_of(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
    """A view over a given table, or a stream of its rows."""
    query = _VIEWS[name].replace('"end"', "`end`")
    if name == "claims":
        query = query.replace("FROM wire", f"FROM ({WIRE}) wire")
    return spark.sql(query.replace(f"FROM {_SOURCES.get(name, 'events')}", "FROM {src}"), src=source)
