"""Tables of a monitored newsroom: every run is one commit of all that it has found."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import migrations as MG
from .operators import analysis as AN
from .operators import ingest as IN
from .operators import revisions as RV
from .sources import fetch as FE
from .tables import Tables

SCHEMAS = {
    "sources": "id long, name string, feed_url string, article_url string, enabled boolean, seq long",
    "articles": "url string, source_id long, title string, published_at timestamp, marker string, seq long, current_revision_id long",
    "revisions": "revision_id long, url string, title string, text string, content_hash string, fetched_at timestamp, seq long",
    "checks": "run_id long, source_id long, checked_at timestamp, status string, candidates_seen long, revisions_created long, failures long, error string",
    **AN.SCHEMAS,
}


class Store:
    """The log of what sources, articles, revisions, checks and analyses there are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = Tables(spark, path, SCHEMAS, MG.NEWEST)

    def log(self, name: str, version: int | None = None) -> DataFrame:
        """Every row ever written to a table, in the newest format."""
        found = self.tables.snapshot(version)
        if found["format"] == MG.NEWEST:
            return self.tables.read(name, found["version"])
        return self._upgraded(found)[name].select(self.tables._columns(name))

    def _upgraded(self, found: dict) -> dict[str, DataFrame]:
        older = MG.schemas(SCHEMAS, found["format"])
        return MG.upgraded({n: self.tables.read(n, found["version"], s) for n, s in older.items()}, found["format"])

    def migrate(self) -> int:
        """Rewrite tables of an older format in the newest; the version that has them."""
        found = self.tables.snapshot()
        if found["format"] == MG.NEWEST:
            return found["version"]
        whole = self._upgraded(found)
        changed = {n: whole[n] for n in MG.FIRST if found["tables"].get(n)}
        return self.tables.commit(changed, since=found["version"], replaced={n: found["tables"][n] for n in changed}, format_=MG.NEWEST)

    def _next(self, rows: DataFrame, column: str) -> int:
        return (rows.agg(F.max(column)).first()[0] or 0) + 1

    def sources(self) -> DataFrame:
        last = F.max_by(F.struct("name", "feed_url", "article_url", "enabled"), "seq").alias("s")
        return self.log("sources").groupBy("id").agg(last).select("id", "s.*")

    def _put(self, rows: DataFrame, since: int) -> None:
        seq = self._next(self.log("sources"), "seq")
        self.tables.commit({"sources": rows.withColumn("seq", F.lit(seq).cast("long"))}, since=since)

    def add_source(self, name: str, feed_url: str, article_url: str | None) -> int:
        """The number of the new source, or of the one that has one of its addresses already."""
        since, known = self.tables.snapshot()["version"], self.sources()
        given = list(dict.fromkeys(u for u in (feed_url, article_url) if u))
        asked = self.spark.createDataFrame([(u,) for u in given], "feed_url string")
        if RV.add_once(known, asked).count() < len(given):
            return known.where(F.col("feed_url").isin(given) | F.col("article_url").isin(given)).agg(F.min("id")).first()[0]
        new = self.spark.createDataFrame([(name, feed_url, article_url, True)], "name string, feed_url string, article_url string, enabled boolean")
        ident = self._next(self.log("sources"), "id")
        self._put(new.withColumn("id", F.lit(ident).cast("long")), since)
        return ident

    def set_enabled(self, ident: int, enabled: bool) -> bool:
        """Whether there is such a source."""
        since = self.tables.snapshot()["version"]
        one = self.sources().where(F.col("id") == ident)
        if one.isEmpty():
            return False
        self._put(RV.set_enabled(one, ident, enabled), since)
        return True

    def revisions(self) -> DataFrame:
        return self.log("revisions").withColumn("fetched_epoch", F.unix_timestamp("fetched_at"))

    def articles(self) -> DataFrame:
        """What is known of every address now, with its current revision."""
        last = F.max_by(F.struct("source_id", "title", "published_at", "marker"), "seq").alias("a")
        now = self.log("revisions").groupBy("url").agg(F.max_by(F.struct("revision_id", "content_hash"), "seq").alias("r"))
        return self.log("articles").groupBy("url").agg(last).join(now, "url", "left").select("url", "a.*", F.col("r.revision_id").alias("current_revision_id"), F.col("r.content_hash").alias("content_hash"))

    def watch(self, get: FE.Get = FE.http_get) -> dict:
        """One poll of all enabled sources; its counters.

        Revisions, articles and checks are one commit: a run that breaks off leaves nothing
        and the next one finds all again.
        """
        since = self.tables.snapshot()["version"]
        now = datetime.now(UTC).replace(microsecond=0)
        run = IN.poll(self.sources(), self.articles().select("url", "content_hash", "marker"), get, F.timestamp_seconds(F.lit(int(now.timestamp()))))
        number, first = self._next(self.log("checks"), "run_id"), self._next(self.log("revisions"), "revision_id")
        seq = F.lit(number).cast("long")
        revisions = run.revisions.withColumns({"revision_id": F.monotonically_increasing_id() + first, "seq": seq})
        articles = run.articles.withColumns({"seq": seq, "current_revision_id": F.lit(None).cast("long")})
        self.tables.commit({"revisions": revisions, "articles": articles, "checks": run.checks.withColumn("run_id", seq)}, since=since)
        return run.summary.drop("started_at").first().asDict()

    def checks(self) -> DataFrame:
        """Checks with a number that grows with their run; a source has one a run."""
        return self.log("checks").withColumn("check_id", F.col("run_id"))

    def done(self) -> DataFrame:
        """(revision_id) of revisions whose analysis is complete."""
        return self.log("outcomes").where("status = 'completed'").select("revision_id").distinct()

    def analyze(self, provider: AN.Provider, search: AN.Search, limit: int, get: FE.Get = FE.http_get) -> dict:
        """One analysis of pending revisions, saved as one commit; its counters."""
        since = self.tables.snapshot()["version"]
        rows = self.revisions().drop("seq", "fetched_at", "content_hash")
        found = AN.run_pending(rows, self.done(), provider, search, get, limit=limit)
        AN.save(found, rows, self.tables, since=since)
        return found.summary.first().asDict()
