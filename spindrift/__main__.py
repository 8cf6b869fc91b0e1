"""Command line: `python -m spindrift <command>`; tables are snapshots under --store."""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import normalize
from .operators import attempts, frontier, specs
from .sources import replay
from .sources.store import SnapshotStore
from .streaming.loops import Crawl


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spindrift")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--answers", help="Parquet of recorded pages: url, html")
    p.add_argument("--rendered", help="Parquet of pages as a browser shows them: url, html")
    p.add_argument("--robots", help="Parquet of recorded robots answers: host (or origin), body, status; with it, what they deny or lack is not fetched")
    p.add_argument("--resolutions", help="Parquet of answers to challenges: url, body; with it, challenges that stay unresolved are failures")
    p.add_argument("--now", default=datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("seed").add_argument("urls", nargs="+")
    for name in ("crawl", "scrape"):
        work = sub.add_parser(name)
        work.add_argument("--rounds", type=int, default=1)
        work.add_argument("--batch", type=int, default=frontier.BATCH_SIZE, help="rows a round; 0: one of every due domain")
        work.add_argument("--no-render", action="store_true")
        work.add_argument("--render-slots", type=int, help="tasks that read rendered pages at a time")
    sub.choices["crawl"].add_argument("--feed-scraper", action="store_true", help="crawled urls become targets of the specs that take them")
    index = sub.add_parser("index")
    index.add_argument("--output")
    index.add_argument("--retry-failed", action="store_true")
    sub.add_parser("reap")
    spec = sub.add_parser("spec").add_subparsers(dest="action", required=True)
    spec.add_parser("add").add_argument("file")
    spec.add_parser("list")
    for name in ("show", "activate", "deactivate"):
        s = spec.add_parser(name)
        s.add_argument("name")
        s.add_argument("--version", type=int)
    submit = sub.add_parser("submit-scrape")
    submit.add_argument("spec")
    submit.add_argument("urls", nargs="+")
    records = sub.add_parser("records").add_subparsers(dest="action", required=True).add_parser("list")
    records.add_argument("spec")
    records.add_argument("--version", type=int)
    records.add_argument("--limit", type=int, default=100)
    records.add_argument("--output")
    sub.add_parser("retention").add_argument("history")
    sub.add_parser("vacuum")
    return p


def recorded(spark: SparkSession, path: str | None) -> DataFrame | None:
    return replay.from_pages(spark.read.parquet(path)).withColumn("url", normalize(F.col("url"))).dropDuplicates(["url"]) if path else None


def show(rows: DataFrame, output: str | None = None) -> None:
    rows.write.mode("overwrite").json(output) if output else print("\n".join(rows.toJSON().toLocalIterator()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, now = SnapshotStore(spark, a.store), F.lit(a.now).cast("timestamp")
    answers = recorded(spark, a.answers)
    robots = spark.read.parquet(a.robots) if a.robots else None
    robots = robots.dropDuplicates(["host" if "host" in robots.columns else "origin"]) if robots is not None else None
    rendered = None if getattr(a, "no_render", False) else recorded(spark, a.rendered)
    resolutions = spark.read.parquet(a.resolutions).dropDuplicates(["url"]) if a.resolutions else None
    none = spark.createDataFrame([], replay.RESPONSES)
    crawl = Crawl(spark, store, none if answers is None else answers, f"{a.store}/history", robots, rendered, resolutions, getattr(a, "feed_scraper", False), getattr(a, "render_slots", None))
    if a.command == "seed":
        crawl.seed(replay.seeds(spark, a.urls), a.now)
    elif a.command == "crawl":
        print(json.dumps({"claimed": [crawl.round(a.now, batch=a.batch or None) for _ in range(a.rounds)]}))
    elif a.command == "scrape":
        print(json.dumps({"scraped": [crawl.scrape_round(a.now, batch=a.batch or None) for _ in range(a.rounds)]}))
    elif a.command == "index":
        if a.retry_failed:
            crawl.retry_failed()
        print(json.dumps({"indexed": crawl.index_all(a.now, (lambda rows: rows.write.mode("append").json(a.output)) if a.output else show)}))
    elif a.command == "reap":
        print(json.dumps({"reaped": crawl.reap(a.now)}))
    elif a.command == "spec":
        known = crawl.read("specs")
        if a.action == "add":
            spec = replay.spec_file(a.file)
            row = [spec | {"spec_id": (known.agg(F.max("spec_id")).first()[0] or 0) + 1}]
            new = spark.createDataFrame(row, "spec_id long, name string, version int, fields string, render_mode string, link_field string, feed_to_crawler boolean, feed_from_crawler boolean, host_pattern string, path_regex string")
            crawl.put(specs=specs.register(known, new.withColumns({"is_active": F.lit(True), "created_at": now})))
        elif a.action in ("activate", "deactivate"):
            crawl.put(specs=specs.set_active(known, a.name, a.action == "activate", a.version))
        else:
            show(specs.listing(known) if a.action == "list" else (known.filter((F.col("name") == a.name) & (F.col("version") == a.version)) if a.version else specs.latest(known).filter(F.col("name") == a.name)))
    elif a.command == "submit-scrape":
        spec_id = specs.latest(crawl.read("specs")).filter(F.col("name") == a.spec).first()["spec_id"]
        crawl.submit(spec_id, replay.seeds(spark, a.urls), a.now)
    elif a.command == "records":
        known = crawl.read("specs").filter(F.col("name") == a.spec)
        spec = (known.filter(F.col("version") == a.version) if a.version else specs.latest(known)).first()
        show(specs.newest_records(crawl.read("records"), crawl.read("targets"), spec["spec_id"], a.limit), a.output)
    elif a.command == "retention":
        print(json.dumps({"dropped": attempts.drop_old(spark, a.history, a.now)}))
    elif a.command == "vacuum":
        store.vacuum()


if __name__ == "__main__":
    main()
