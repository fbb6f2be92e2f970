"""Commands: ``source``, ``watch``, ``analyze`` and ``report``; 0 on success, 2 where something is amiss."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from importlib.metadata import entry_points

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import settings as S
from .functions import redact as R
from .functions import urls as U
from .operators import analysis as AN
from .operators import revisions as RV
from .store import Store

#: Entry points of installed plug-ins: functions of the settings, by the names that settings give.
PROVIDER_GROUP, SEARCH_GROUP = "pressdelta.providers", "pressdelta.searches"
#: Providers of analysis and search that need no plug-in.
PROVIDERS: dict[str, Callable[[S.Settings], AN.Provider]] = {}
SEARCHES: dict[str, Callable[[S.Settings], AN.Search]] = {"none": lambda settings: AN.no_search}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pressdelta")
    top.add_argument("--env-file", default=".env")
    commands = top.add_subparsers(dest="command", required=True)
    source = commands.add_parser("source").add_subparsers(dest="action", required=True)
    add = source.add_parser("add")
    for option, must in (("--name", True), ("--feed-url", True), ("--article-url", False)):
        add.add_argument(option, required=must)
    source.add_parser("list")
    for action in ("enable", "disable"):
        source.add_parser(action).add_argument("--id", type=int, required=True)
    commands.add_parser("watch").add_argument("--once", action="store_true", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("--pending", action="store_true", required=True)
    analyze.add_argument("--limit", default="20")
    commands.add_parser("report")
    return top


def plugged(name: str, own: dict, group: str):
    """What a name stands for: one of our own, else an installed plug-in's entry point."""
    if name in own:
        return own[name]
    for point in entry_points(group=group, name=name):
        try:
            return point.load()
        except (ImportError, AttributeError) as e:
            raise ValueError(f"plug-in {name} cannot be loaded") from e
    raise ValueError(f"no such provider: {name}")


def _told(counters: dict) -> None:
    print(" ".join(f"{k}={v}" for k, v in counters.items()))


def _source(args, store: Store) -> int:
    if args.action == "list":
        for r in store.sources().select("id", "name", "enabled", U.redact_url(F.col("feed_url")).alias("url")).orderBy("id").toLocalIterator():
            print(f"{r.id}\t{'enabled' if r.enabled else 'disabled'}\t{r.name}\t{r.url}")
        return 0
    if args.action == "add":
        given = [u for u in (args.feed_url, args.article_url) if u is not None]
        web = store.spark.createDataFrame([(u,) for u in given], "u string").select(U.is_http(F.col("u")).alias("ok")).where("NOT ok").isEmpty()
        if not args.name.strip() or not web:
            raise ValueError("a source needs a name and HTTP(S) addresses")
        print(f"source {store.add_source(args.name.strip(), args.feed_url, args.article_url)}")
        return 0
    return 0 if store.set_enabled(args.id, args.action == "enable") else 2


def _analyze(args, store: Store, settings: S.Settings) -> int:
    if not args.limit.isdecimal() or int(args.limit) < 1:
        raise ValueError("--limit must be a positive integer")
    if settings.missing():
        raise ValueError("missing: " + ", ".join(settings.missing()))
    provider = plugged(settings.llm_provider, PROVIDERS, PROVIDER_GROUP)(settings)
    search = plugged(settings.web_search_provider, SEARCHES, SEARCH_GROUP)(settings)
    _told(store.analyze(provider, search, int(args.limit)))
    return 0


def _report(store: Store, settings: S.Settings) -> int:
    for name, value in settings.runtime().items():
        print(f"{name}\t{value}")
    for r in RV.source_health(store.checks()).select("source_id", "status", "candidates_seen", R.safe_error(F.col("error")).alias("error")).orderBy("source_id").toLocalIterator():
        print(f"source {r.source_id}\t{r.status}\t{r.candidates_seen}\t{r.error or ''}")
    _told(store.revisions().agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("url").alias("articles")).first().asDict())
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = S.load(args.env_file)
        store = Store(spark or SparkSession.builder.getOrCreate(), settings.data_dir)
        if args.command == "source":
            return _source(args, store)
        if args.command == "watch":
            _told(store.watch())
            return 0
        return _analyze(args, store, settings) if args.command == "analyze" else _report(store, settings)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
