"""Continuous work: rounds of crawling, scraping and indexing over a store, and Structured Streaming queries.

A round reads the store, makes the changed rows of every table that it touches, and commits them all at once: one that ends
early has changed nothing but its leases, which expire. What a round writes follows from its batch, so a batch should be
as large as the work that is due (batch=None takes one row of every due domain), not as a table is long. A micro-batch of
a stream is handed to the same functions by foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import policy
from ..functions.fetching import has_body
from ..functions.urls import normalize, registrable_host, robots_origin
from ..operators import attempts as history
from ..operators import extract, frontier, index, specs
from ..schemas import CRAWL_DELAY_DEFAULT_MS, INDEX_BATCH, LINKS, MAX_DEPTH, SCRAPE_SPECS, SCRAPE_TARGETS, SCRAPED_RECORDS
from ..sources import replay
from ..sources.scratch import cut
from ..sources.store import BLOB, SnapshotStore, compress

URLS = "url_id long, domain_id long, host string, url string, url_key string, depth int, priority int, status string, lease_owner string, lease_expires_at timestamp, discovered_at timestamp, next_crawl_at timestamp, last_crawled_at timestamp, last_status_code int, attempt_count int, consecutive_failures int, etag string, last_modified string, content_sha256 string, simhash long, render_mode string"
DOMAINS = "domain_id long, host string, origin string, is_crawlable boolean, next_available_at timestamp, crawl_delay_ms int, js_required boolean, js_evidence_count int, robots_body string, robots_status short, robots_fetched_at timestamp, robots_expires_at timestamp, pages_discovered long, pages_crawled long, error_count long, created_at timestamp"
DOCUMENTS = "url_id long, url string, title string, description string, lang string, text string, word_count int, content_sha256 string, simhash long, raw_key string, text_key string, index_state string, duplicate_of long, indexed_at timestamp, updated_at timestamp"
KEYS = {"urls": ["url_id"], "domains": ["domain_id"], "documents": ["url_id"], "links": ["from_url_id", "to_url_id"], "blobs": ["key"], "specs": None, "targets": ["target_id"], "records": ["target_id"]}


@cache
def _schema(name: str) -> StructType:
    known = {"links": LINKS, "blobs": BLOB, "specs": SCRAPE_SPECS, "targets": SCRAPE_TARGETS, "records": SCRAPED_RECORDS}
    return known[name] if name in known else StructType.fromDDL({"urls": URLS, "domains": DOMAINS, "documents": DOCUMENTS}[name])


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _counted(counts: DataFrame, counter: str, rows: DataFrame) -> DataFrame:
    """counts (domain_id, counter, n) with a row for each domain of rows."""
    return counts.unionByName(rows.groupBy("domain_id").agg(F.count("*").alias("n")).select("domain_id", F.lit(counter).alias("counter"), "n"))


class Crawl:
    """Rounds of claim, robots check, fetch, extraction and commit over recorded answers.

    robots: recorded answers (host or origin, body, status); with them hosts are closed until theirs is read, and urls that
    it denies are skipped. rendered: answers of a browser, which pages that lack their content, and domains known for such
    pages, take. resolutions: answers (url, body) to challenges; with them a challenge that stays unresolved is a failure.
    feed_scraper: crawled urls become targets of the active specs that take them.
    """

    def __init__(self, spark: SparkSession, store: SnapshotStore, answers: DataFrame, history_path: str | None = None, robots: DataFrame | None = None, rendered: DataFrame | None = None, resolutions: DataFrame | None = None, feed_scraper: bool = False, slots: int | None = None) -> None:
        self.spark, self.store, self.answers, self.history = spark, store, answers, history_path
        self.robots, self.rendered, self.resolutions, self.feed_scraper, self.slots = robots, rendered, resolutions, feed_scraper, slots

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, _schema(name))

    def put(self, **changes: DataFrame) -> None:
        """Commit changed rows of tables, in the columns that these have, at once."""
        puts = {}
        for name, rows in changes.items():
            fields = _schema(name).fields
            puts[name] = (rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), KEYS[name])
        self.store.commit(puts)

    def seed(self, raw: DataFrame, now: str) -> None:
        """Put seeds (url, place) into the frontier, with domains for their hosts."""
        urls, domains = self._inserted(frontier.seed(raw, self.read("urls"), at(now)), self.read("domains"), at(now))
        self.put(urls=urls, domains=domains)

    def _inserted(self, new: DataFrame, domains: DataFrame, t: Column) -> tuple[DataFrame, DataFrame]:
        """(rows of new urls with their ids, rows of the domains that are new with them). Ids go on from the largest, in the
        order in which the urls were found."""
        first = self.read("urls").agg(F.coalesce(F.max("url_id"), F.lit(0))).first()[0]
        new = frontier.dense_ids(new.filter("host is not null"), ["place"], first + 1, "url_id")
        hosts = cut(self._new_domains(new.select("host", "url", "url_id"), domains, t), "new_domains")
        ids = domains.select("host", "domain_id").unionByName(hosts.select("host", "domain_id"))
        rows = new.join(ids, "host").withColumns({"attempt_count": F.lit(0), "consecutive_failures": F.lit(0), "discovered_at": t})
        return rows.drop("place"), hosts

    def _new_domains(self, rows: DataFrame, domains: DataFrame, t: Column) -> DataFrame:
        """Domains for hosts that have none, with the smallest id of their rows (host, url, url_id)."""
        new = rows.groupBy("host").agg(F.min(F.struct("url_id", "url")).alias("f")).join(domains.select("host"), "host", "left_anti")
        defaults = {"origin": robots_origin(F.col("f.url")), "is_crawlable": F.lit(self.robots is None), "next_available_at": t, "crawl_delay_ms": F.lit(CRAWL_DELAY_DEFAULT_MS), "js_required": F.lit(False), "js_evidence_count": F.lit(0), "created_at": t}
        zero = {c: F.lit(0).cast("long") for c in ("pages_discovered", "pages_crawled", "error_count")}
        return new.withColumns({"domain_id": F.col("f.url_id")} | defaults | zero).drop("f")

    def refresh_robots(self, now: str) -> None:
        """Stale hosts, not only claimed ones, get their answer: one closed by an answer that was not final can open again."""
        stale = cut(policy.hosts_to_refresh(self.read("domains"), at(now)), "stale")
        if self.robots is not None and not stale.isEmpty():
            self.put(domains=policy.refresh(stale, replay.robots_of(stale.select("host", "origin"), self.robots), at(now)))

    def reap(self, now: str) -> dict[str, int]:
        """Rows of expired leases go back to their queues; their numbers."""
        late = {name: frontier.reap(self.read(name), at(now)).filter("reaped") for name in ("urls", "targets")}
        counts = {name: rows.count() for name, rows in late.items()}
        self.put(**{name: late[name] for name, n in counts.items() if n})
        return counts

    def policies(self) -> DataFrame:
        """What the answers that domains hold say, parsed once a host."""
        return replay.robots(self.read("domains").select("host", F.col("robots_body").alias("body"), F.col("robots_status").cast("int").alias("status")))

    def fetch(self, tasks: DataFrame, render: Column | None = None) -> DataFrame:
        """tasks (host, url, js_required, ...) with their outcome, from robots check to resolved challenges.

        render: true where only a rendered page will do, false where only a static one will; null, or None: as a page needs.
        """
        denied = None
        if self.robots is not None:
            tasks, denied = replay.split_allowed(tasks, self.policies())
        if self.rendered is None:
            got = replay.fetch(tasks, self.answers).withColumn("js_evidence", F.lit(False))
        else:
            want = F.lit(None).cast("boolean") if render is None else render
            got = replay.fetch_with_render(tasks.withColumn("_mode", want), self.answers, self.rendered, self.slots, "_mode").drop("_mode")
        if self.resolutions is not None:
            got = replay.resolve_challenges(got, self.resolutions)
        else:
            got = got.withColumn("resolution", F.lit(None).cast("string"))
        return got if denied is None else got.unionByName(denied, allowMissingColumns=True)

    def round(self, now: str, worker: str = "worker", batch: int | None = frontier.BATCH_SIZE) -> int:
        """One round over one claimed batch; the number of claimed urls. Expired leases go back to the queue first."""
        t = at(now)
        self.refresh_robots(now)
        self.reap(now)
        urls, domains = self.read("urls"), self.read("domains")
        claimed = cut(frontier.claim(urls, domains, t, batch), "claimed")
        n = claimed.count()
        if not n:
            return 0
        taken = domains.join(claimed.select("domain_id"), "domain_id", "left_semi")
        self.put(domains=frontier.advance_domains(taken, claimed, t), urls=frontier.leased(claimed, worker, t))
        mine = frontier.leased(claimed, worker, t)
        got = cut(self.fetch(mine), "fetched")
        self._commit(got, t, worker)
        return n

    def _record(self, got: DataFrame, t: Column, worker: str) -> None:
        rows = got.select("url_id", t.alias("started_at"), "duration_ms", "status_code", "render_mode", F.octet_length("body").cast("long").alias("bytes"), "error_class", "challenge_type", "error_detail", F.lit(worker).alias("worker_id"), "outcome")
        history.append(rows, self.history)

    def _commit(self, got: DataFrame, t: Column, worker: str) -> None:
        if self.history:
            self._record(got, t, worker)
        whole = has_body(F.col("outcome"), F.octet_length("body"))
        pages = cut(extract.extract_pages(got.filter(whole).select("url_id", "domain_id", "host", "depth", "url", F.col("body").alias("html"))), "pages")
        key = lambda prefix, ext: extract.blob_key(prefix, F.col("host"), F.col("url_id"), ext)
        pages = pages.withColumns({"raw_key": key("raw", "html"), "text_key": key("text", "txt")})
        docs = pages.drop("domain_id", "host", "depth", "links", "canonical_url").withColumns({"index_state": F.lit("pending"), "updated_at": t})
        raw = got.join(pages.select("url_id", F.col("raw_key").alias("key")), "url_id").select("key", F.col("body").alias("payload"))
        blobs = compress(raw.unionByName(pages.select(F.col("text_key").alias("key"), F.col("text").alias("payload"))))

        told = got.drop(*[c for c in ("content_sha256", "simhash", "last_status_code") if c in got.columns])
        own = told.join(pages.select("url_id", "content_sha256", "simhash", F.lit(True).alias("_doc")), "url_id", "left").withColumn("last_status_code", F.col("status_code"))
        failed = ~F.col("outcome").isin("ok", "not_modified", "robots_denied") | (F.coalesce("resolution", F.lit("")) == "unresolved")
        kept = self.read("urls").select("url_id", F.struct("content_sha256", "simhash", "last_status_code", "render_mode").alias("_old"))
        own = own.join(kept, "url_id")
        same = {c: F.col(f"_old.{c}") for c in ("content_sha256", "simhash", "render_mode")}
        parts = [
            frontier.complete(own.filter("_doc"), t).withColumns({"etag": F.col("new_etag"), "last_modified": F.col("new_last_modified")}),
            frontier.skip(own.filter("outcome = 'robots_denied' or (outcome = 'ok' and _doc is null)")).withColumns(same | {"last_status_code": F.col("_old.last_status_code")}),
            frontier.reschedule(own.filter("outcome = 'not_modified'"), t).withColumns(same | {"last_crawled_at": t, "last_status_code": F.col("_old.last_status_code")}),
            frontier.fail(own.filter(failed), t).withColumns(same),
        ]
        changed = cut(self._like("urls", parts), "changed")

        links = cut(pages.select("url_id", "depth", F.posexplode("links").alias("place", "l")).select(F.col("url_id").alias("from_url_id"), "depth", F.struct("url_id", "place").alias("place"), "l.*").filter(F.col("depth") < MAX_DEPTH), "links")
        domains = self.read("domains")
        new, hosts = self._inserted(frontier.add_links(links, self.read("urls"), t), domains, t)
        known = self.read("urls").select("url", "url_id").unionByName(new.select("url", "url_id"))
        edges = frontier.add_edges(links, known, self.read("links")).withColumn("first_seen_at", t)

        ids = domains.select("host", "domain_id").unionByName(hosts.select("host", "domain_id"))
        seen = links.select(registrable_host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n")).join(ids, "host").select("domain_id", F.lit("pages_discovered").alias("counter"), "n")
        counts = _counted(_counted(seen, "pages_crawled", own.filter("_doc")), "error_count", own.filter(failed))
        counts = _counted(counts, "js_evidence_count", got.filter("js_evidence"))
        raised = self._raised(domains.unionByName(hosts, allowMissingColumns=True), hosts, cut(counts, "counts"))
        more = {}
        if self.feed_scraper:
            more["targets"] = self._enrolled(changed.filter("status = 'done'").select("url", "url_key", "domain_id", "host"), t)
        self.put(blobs=blobs, documents=docs, urls=changed.unionByName(new, allowMissingColumns=True), domains=raised, links=edges, **more)

    def _like(self, table: str, parts: list[DataFrame]) -> DataFrame:
        fields = _schema(table).fields
        out = None
        for p in parts:
            p = p.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
            out = p if out is None else out.unionByName(p)
        return out

    def _raised(self, domains: DataFrame, new: DataFrame, counts: DataFrame) -> DataFrame:
        """The domains that counts (domain_id, counter, n) change, and the new ones."""
        names = ["pages_discovered", "pages_crawled", "error_count", "js_evidence_count"]
        sums = counts.groupBy("domain_id").pivot("counter", names).agg(F.sum("n"))
        sums = sums.select("domain_id", *[F.coalesce(n, F.lit(0)).alias(f"_{n}") for n in names])
        touched = sums.select("domain_id").unionByName(new.select("domain_id")).distinct()
        out = domains.join(touched, "domain_id", "left_semi").join(sums, "domain_id", "left")
        out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)) for n in names})
        enough = F.coalesce(F.col("_js_evidence_count") > 0, F.lit(False)) & (F.col("js_evidence_count") >= frontier.JS_EVIDENCE)
        return out.withColumn("js_required", F.coalesce("js_required", F.lit(False)) | enough).drop(*[f"_{n}" for n in names])

    def _enrolled(self, urls: DataFrame, t: Column) -> DataFrame:
        """New targets for crawled urls."""
        known = self.read("targets")
        found = frontier.enroll(urls, self.read("specs"), known)
        first = known.agg(F.coalesce(F.max("target_id"), F.lit(0))).first()[0] + 1
        return frontier.dense_ids(found, ["spec_id", "url_key"], first, "target_id").withColumns({"status": F.lit("pending"), "discovered_at": t, "next_attempt_at": t, "attempt_count": F.lit(0), "consecutive_failures": F.lit(0)})

    def submit(self, spec_id: int, raw: DataFrame, now: str) -> None:
        """New targets of a spec for urls (url, place), with domains for their hosts."""
        t, known = at(now), self.read("targets")
        new = specs.submit(spec_id, raw, known, t).filter("host is not null")
        first = known.agg(F.coalesce(F.max("target_id"), F.lit(0))).first()[0] + 1
        new = frontier.dense_ids(new, ["place"], first, "target_id")
        domains = self.read("domains")
        # Domain ids follow url ids; hosts without urls get theirs below these.
        least = min(0, domains.agg(F.coalesce(F.min("domain_id"), F.lit(0))).first()[0])
        hosts = cut(self._new_domains(new.select("host", "url", (F.lit(least - 1) - F.col("target_id")).alias("url_id")), domains, t), "new_domains")
        ids = domains.select("host", "domain_id").unionByName(hosts.select("host", "domain_id"))
        rows = new.join(ids, "host").withColumns({"discovered_at": t, "attempt_count": F.lit(0), "consecutive_failures": F.lit(0)})
        self.put(targets=rows, domains=hosts)

    def scrape_round(self, now: str, worker: str = "scraper", batch: int | None = frontier.BATCH_SIZE) -> dict[str, int]:
        """One round over claimed targets of active specs: robots check, fetch as the spec's render mode asks for, fields,
        records, and the frontier's share of their links. The number of targets by what became of them."""
        t = at(now)
        self.refresh_robots(now)
        self.reap(now)
        domains, known = self.read("domains"), self.read("specs")
        claimed = cut(specs.claim_targets(self.read("targets"), known, domains, t, batch), "claimed")
        if claimed.isEmpty():
            return {}
        taken = domains.join(claimed.select("domain_id"), "domain_id", "left_semi")
        mine = frontier.leased(claimed, worker, t)
        self.put(domains=frontier.advance_domains(taken, claimed, t), targets=mine)
        # The specs may have changed since the claim: they are read again.
        spec = self.read("specs").select("spec_id", "fields", "link_field", "feed_to_crawler", "is_active", F.coalesce("render_mode", F.lit("auto")).alias("mode"), F.lit(True).alias("there"))
        tasks = mine.join(spec, "spec_id", "left")
        why = F.when(F.col("there").isNull(), "spec_missing").when(~F.col("is_active"), "spec_inactive")
        if self.rendered is None:
            why = why.when(F.col("mode") == "always", "render_required_unavailable")
        tasks = cut(tasks.withColumn("why", why), "tasks")
        render = F.when(F.col("mode") == "always", True).when(F.col("mode") == "never", False)
        got = cut(self.fetch(tasks.filter("why is null"), render).unionByName(tasks.filter("why is not null"), allowMissingColumns=True), "fetched")
        rows = got.withColumns({"html": F.when(F.col("outcome") == "ok", F.col("body")), "fields": F.coalesce("fields", F.lit("[]"))})
        rows = cut(extract.scrape_targets(rows), "scraped").withColumn("last_status_code", F.col("status_code"))
        failed = F.col("outcome").isNotNull() & (~F.col("outcome").isin("ok", "not_modified", "robots_denied") | (F.coalesce("resolution", F.lit("")) == "unresolved"))
        became = F.coalesce("why", F.when(failed, "failed").when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("data").isNull(), "no_content").otherwise("done"))
        rows = cut(rows.withColumns({"became": became, "raw_key": extract.blob_key("scrape", F.col("host"), F.col("target_id"), "html")}), "became")
        done = rows.filter("became = 'done'")
        records = done.select("target_id", "spec_id", "data", "raw_key", t.alias("extracted_at"), t.alias("updated_at"))
        keys = {"etag": F.col("new_etag"), "last_modified": F.col("new_last_modified")}
        parts = [
            frontier.complete(done, t, "last_attempted_at", "next_attempt_at").withColumns(keys),
            frontier.reschedule(rows.filter("became = 'not_modified'"), t, "next_attempt_at"),
            frontier.fail(rows.filter("became = 'failed'"), t, due_col="next_attempt_at"),
            frontier.skip(rows.filter("became not in ('done', 'not_modified', 'failed')")),
        ]
        blobs = compress(done.select(F.col("raw_key").alias("key"), F.col("body").alias("payload")))
        fed = done.filter("feed_to_crawler and size(links) > 0").select("url", "links", F.col("target_id").alias("place"))
        new, hosts = self._inserted(frontier.feed_links(fed, self.read("urls"), t), domains, t)
        counts = dict(rows.groupBy("became").count().collect())
        self.put(blobs=blobs, records=records, targets=self._like("targets", parts), urls=new, domains=hosts)
        return counts

    def drain_index(self, now: str, sink: Callable[[DataFrame], None] | None = None, batch: int | None = None) -> DataFrame:
        """Index pending documents (all, or the `batch` that have waited longest), suppress near duplicates, hand the others
        to sink; what the index gets. Where sink fails, the documents are marked as failed and nothing else changes."""
        docs = self.read("documents")
        waiting = docs.filter("index_state = 'pending'") if batch is None else index.pending(docs, batch)
        waiting = cut(waiting, "waiting")
        drained = cut(index.drain(waiting, at(now), indexed=docs.filter("index_state = 'indexed'").select("url_id", "simhash")), "drained")
        out = index.payload(drained.filter("index_state = 'indexed'").select("url_id", "url", "title", "description", "lang", "text"))
        try:
            if sink is not None:
                sink(out)
        except Exception:
            self.put(documents=index.mark(waiting, waiting, "failed", at(now)))
            raise
        self.put(documents=drained)
        return out

    def index_all(self, now: str, sink: Callable[[DataFrame], None], batch: int = INDEX_BATCH) -> int:
        """Batches until none is pending; the number of documents that the index got."""
        n = 0
        while not self.read("documents").filter("index_state = 'pending'").isEmpty():
            n += self.drain_index(now, sink, batch).count()
        return n

    def retry_failed(self) -> None:
        """Failed documents are pending again."""
        self.put(documents=index.retry_failed(self.read("documents").filter("index_state = 'failed'")))


def watch_seeds(crawl: Crawl, folder: str, checkpoint: str, now: str, forever: bool = False) -> StreamingQuery:
    """Seeds from text files that arrive in a folder, a url a line."""
    lines = crawl.spark.readStream.text(folder)

    def put(batch: DataFrame, _: int) -> None:
        crawl.seed(batch.filter("value <> ''").select(normalize(F.col("value")).alias("url"), F.monotonically_increasing_id().alias("place")).filter("url is not null"), now)

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="5 seconds") if forever else writer.trigger(availableNow=True)).start()


def stream_attempts(events: DataFrame, path: str, checkpoint: str, forever: bool = False) -> StreamingQuery:
    """An attempts stream (started_at, ...) into its monthly folders."""
    rows = events.withColumn("started_month", history.month(F.col("started_at")))
    writer = rows.writeStream.format("parquet").partitionBy("started_month").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="60 seconds") if forever else writer.trigger(availableNow=True)).start()


def windowed_outcomes(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcome counts of an attempts stream in windows of event time; rows later than `late` are left out."""
    return events.withWatermark("started_at", late).groupBy(F.window("started_at", width), "outcome").agg(F.count("*").alias("n"))
