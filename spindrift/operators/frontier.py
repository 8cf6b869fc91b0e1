"""The frontier: a work queue of URLs as DataFrames.

Every operator is a function of tables and a given `now`: nothing reads a clock. Changes are given as the changed rows
or as a new table; a store writes them as a new snapshot, one writer at a time, so no rows need locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize, registrable_host, url_key
from ..sources.scratch import cut
from ..schemas import (
    BACKOFF_DOUBLINGS,
    BACKOFF_MINUTES,
    BATCH_SIZE,
    DEFAULT_PRIORITY,
    JS_EVIDENCE,
    LEASE_SECONDS,
    MAX_DEPTH,
    MAX_FAILURES,
    RECRAWL_DAYS,
    SEED_PRIORITY,
)


def days(n: int) -> Column:
    return F.expr(f"interval {n} days")


def seconds(n: int) -> Column:
    return F.expr(f"interval {n} seconds")


def new_urls(raw: DataFrame, known: DataFrame | None = None, raw_col: str = "url", place_col: str | None = None) -> DataFrame:
    """url, url_key, host of the different canonical URLs of `raw` that `known` (url_key) lacks; the first by place stays.

    The first is a minimum, combined before the shuffle, so a URL that a third of all rows name costs a row a task.
    """
    url = normalize(F.col(raw_col))
    rows = raw.select(url.alias("url"), *([F.col(place_col).alias("place")] if place_col else [])).filter("url is not null")
    first = [F.min("place").alias("place")] if place_col else []
    out = rows.groupBy("url").agg(*first, F.count("*").alias("n_seen")).select(url_key(F.col("url")).alias("url_key"), "url", registrable_host(F.col("url")).alias("host"), *(["place"] if place_col else []), "n_seen")
    return out if known is None else out.join(known.select("url_key"), "url_key", "left_anti")


def upsert_domains(hosts: DataFrame, domains: DataFrame, place_col: str) -> DataFrame:
    """host, domain_id of all hosts: known ones keep their id, a new one has the smallest place of its rows."""
    new = hosts.filter("host is not null").groupBy("host").agg(F.min(place_col).alias("domain_id")).join(domains.select("host"), "host", "left_anti")
    return domains.select("host", "domain_id").unionByName(new)


def seed(raw: DataFrame, known: DataFrame, now: Column, raw_col: str = "url", place_col: str = "place") -> DataFrame:
    """New rows for seeds: depth 0, the seeds' priority, due now."""
    return new_urls(raw, known, raw_col, place_col).withColumns({"depth": F.lit(0), "priority": F.lit(SEED_PRIORITY), "status": F.lit("pending"), "next_crawl_at": now}).drop("n_seen")


def _gate(domains: DataFrame, now: Column, strict: bool) -> DataFrame:
    return domains.filter(F.col("is_crawlable") & (F.col("next_available_at") <= now)) if strict else domains


def claim(urls: DataFrame, domains: DataFrame, now: Column, batch: int | None = BATCH_SIZE, strict: bool = True, due_col: str = "next_crawl_at", id_col: str = "url_id") -> DataFrame:
    """The best due row of each of the first `batch` domains (None: of all) that have any: highest priority, then longest due, then id.

    With `strict`, domains that may not be crawled, or not yet, give nothing. A domain's best row is a minimum over the
    three columns of the order alone, combined before the shuffle: a domain with a third of all rows costs a row a task.
    The rows themselves are then met by id.
    """
    due = urls.filter((F.col("status") == "pending") & (F.col(due_col) <= now))
    order = ([(-F.col("priority")).alias("p")] if "priority" in urls.columns else []) + [F.col(due_col).alias("d"), F.col(id_col).alias("i")]
    best = due.select("domain_id", F.struct(*order).alias("o")).groupBy("domain_id").agg(F.min("o").alias("o")).select("domain_id", F.col("o.i").alias(id_col))
    gate = _gate(domains, now, strict).select("domain_id", "host", *[c for c in ("js_required",) if c in domains.columns])
    best = best.join(gate, "domain_id")
    best = best if batch is None else best.orderBy("domain_id").limit(batch)
    rest = [c for c in urls.columns if c not in (id_col, "domain_id", "host")]
    return best.join(due.select(id_col, *rest), id_col).select("domain_id", "host", *[c for c in ("js_required",) if c in domains.columns], id_col, *rest)


def _leasing(worker: str, now: Column, lease_s: int) -> dict[str, Column]:
    return {"status": F.lit("leased"), "lease_owner": F.lit(worker), "lease_expires_at": now + seconds(lease_s), "attempt_count": F.col("attempt_count") + 1}


def leased(rows: DataFrame, worker: str, now: Column, lease_s: int = LEASE_SECONDS) -> DataFrame:
    """Claimed rows under a lease."""
    return rows.withColumns(_leasing(worker, now, lease_s))


def lease(urls: DataFrame, claimed: DataFrame, worker: str, now: Column, lease_s: int = LEASE_SECONDS, id_col: str = "url_id") -> DataFrame:
    """urls with the claimed rows leased."""
    hit = F.coalesce(F.col("_mine"), F.lit(False))
    put = {k: F.when(hit, v).otherwise(F.col(k)) for k, v in _leasing(worker, now, lease_s).items()}
    return urls.join(claimed.select(F.col(id_col), F.lit(True).alias("_mine")), id_col, "left").withColumns(put).drop("_mine")


def advance_domains(domains: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """domains of claimed rows become available again after their crawl delay."""
    hit = claimed.select("domain_id").distinct().withColumn("_hit", F.lit(True))
    after = now + F.make_dt_interval(secs=(F.col("crawl_delay_ms") / 1000).cast("decimal(18,6)"))
    return domains.join(hit, "domain_id", "left").withColumn("next_available_at", F.when(F.col("_hit"), after).otherwise(F.col("next_available_at"))).drop("_hit")


def reap(rows: DataFrame, now: Column) -> DataFrame:
    """rows with those whose lease has expired pending again, and `reaped` telling which."""
    late = F.coalesce((F.col("status") == "leased") & (F.col("lease_expires_at") < now), F.lit(False))
    held = {c: F.when(~F.col("reaped"), F.col(c)) for c in ("lease_owner", "lease_expires_at")}
    return rows.withColumn("reaped", late).withColumns({"status": F.when(F.col("reaped"), "pending").otherwise(F.col("status"))} | held)


def renew(rows: DataFrame, worker: Column, now: Column, lease_s: int = LEASE_SECONDS) -> DataFrame:
    """rows with the worker's own leases prolonged, and `renewed` telling which."""
    mine = F.coalesce((F.col("status") == "leased") & (F.col("lease_owner") == worker), F.lit(False))
    return rows.withColumn("renewed", mine).withColumn("lease_expires_at", F.when(F.col("renewed"), now + seconds(lease_s)).otherwise(F.col("lease_expires_at")))


def _released(changed: dict[str, Column]) -> dict[str, Column]:
    return {"lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")} | changed


def fail(rows: DataFrame, now: Column, most: int = MAX_FAILURES, due_col: str = "next_crawl_at") -> DataFrame:
    """Failed attempts: pending again after a doubling delay, or failed for good at the last allowed failure."""
    n = F.col("consecutive_failures")
    delay = F.make_dt_interval(mins=F.lit(BACKOFF_MINUTES)) * F.pow(F.lit(2), F.least(n, F.lit(BACKOFF_DOUBLINGS)))
    out = rows.withColumns(_released({due_col: now + delay, "status": F.when(n + 1 >= most, "failed").otherwise("pending")}))
    return out.withColumn("consecutive_failures", n + 1)


def complete(rows: DataFrame, now: Column, at_col: str = "last_crawled_at", due_col: str = "next_crawl_at") -> DataFrame:
    """Finished rows: done, due again in a week, no failures."""
    return rows.withColumns(_released({"status": F.lit("done"), at_col: now, due_col: now + days(RECRAWL_DAYS), "consecutive_failures": F.lit(0)}))


def reschedule(rows: DataFrame, now: Column, due_col: str = "next_crawl_at") -> DataFrame:
    """Rows that have not changed since the last visit: as finished ones, but nothing about their content is touched."""
    return rows.withColumns(_released({"status": F.lit("done"), due_col: now + days(RECRAWL_DAYS), "consecutive_failures": F.lit(0)}))


def skip(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_released({"status": F.lit("skipped")}))


def due_for_recrawl(rows: DataFrame, now: Column) -> DataFrame:
    """Finished rows whose week is over, pending again."""
    return rows.filter((F.col("status") == "done") & (F.col("next_crawl_at") <= now)).withColumn("status", F.lit("pending"))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys: an upsert."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def add_links(links: DataFrame, known: DataFrame, now: Column, max_depth: int = MAX_DEPTH, priority: int = DEFAULT_PRIORITY) -> DataFrame:
    """New rows for discovered links (url canonical, host, depth of the page, place): one level deeper, within max_depth.

    The first page to name a URL, by place, gives its depth.
    """
    rows = links.filter(F.col("depth") < max_depth).select("url", "place", (F.col("depth") + 1).alias("depth"))
    first = rows.groupBy("url").agg(F.min(F.struct("place", "depth")).alias("f"))
    out = first.select(url_key(F.col("url")).alias("url_key"), "url", registrable_host(F.col("url")).alias("host"), "f.place", "f.depth")
    return out.join(known.select("url_key"), "url_key", "left_anti").withColumns({"priority": F.lit(priority), "status": F.lit("pending"), "next_crawl_at": now})


def add_edges(links: DataFrame, urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """from_url_id, to_url_id, anchor_text, rel of links (from_url_id, url, place, ...) to known urls; the first anchor stays."""
    first = links.groupBy("from_url_id", "url").agg(F.min(F.struct("place", "anchor_text", "rel")).alias("f"))
    out = first.join(urls.select("url", F.col("url_id").alias("to_url_id")), "url").select("from_url_id", "to_url_id", "f.anchor_text", "f.rel")
    return out if known is None else out.join(known.select("from_url_id", "to_url_id"), ["from_url_id", "to_url_id"], "left_anti")


def js_evidence(domains: DataFrame, rendered: DataFrame) -> DataFrame:
    """domains with evidence from rendered pages (host) added, and js_required once there is enough."""
    n = rendered.groupBy("host").agg(F.count("*").cast("int").alias("_n"))
    out = domains.join(n, "host", "left").withColumn("js_evidence_count", F.col("js_evidence_count") + F.coalesce("_n", F.lit(0)))
    return out.withColumn("js_required", F.col("js_required") | (F.col("_n").isNotNull() & (F.col("js_evidence_count") >= JS_EVIDENCE))).drop("_n")


def domain_counters(domains: DataFrame, changes: DataFrame, counter: str) -> DataFrame:
    """domains with a counter raised by the number of its rows in `changes` (domain_id), combined before they meet."""
    n = changes.groupBy("domain_id").agg(F.count("*").alias("_n"))
    return domains.join(n, "domain_id", "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n")


def enroll(urls: DataFrame, specs: DataFrame, known: DataFrame | None = None, block: int = 200) -> DataFrame:
    """spec_id, url, url_key, domain_id: urls (a row each) that active specs which take crawled pages match, by host and by pattern.

    A spec without a host or a pattern takes any. Specs with a host meet urls on it. Those without, which are written by
    hand, become patterns of the plan, `block` at a time: a url is read once a block and gives a row for each that fits.
    """
    active = specs.filter("is_active and feed_from_crawler").select("spec_id", "host_pattern", "path_regex")
    fits = F.col("path_regex").isNull() | F.expr("url rlike path_regex")
    kept = ["spec_id", "url", "url_key", "domain_id"]
    out = urls.join(active.filter("host_pattern is not null").withColumnRenamed("host_pattern", "host"), "host").filter(fits).select(*kept)
    anywhere = [tuple(r) for r in active.filter("host_pattern is null").select("spec_id", "path_regex").orderBy("spec_id").toLocalIterator()]
    for i in range(0, len(anywhere), block):
        ids = F.array(*[F.when(F.lit(True) if p is None else F.col("url").rlike(p), F.lit(k)) for k, p in anywhere[i : i + block]])
        out = out.unionByName(urls.select(F.explode(F.array_compact(ids)).alias("spec_id"), *kept[1:]))
    return out if known is None else out.join(known.select("spec_id", "url_key"), ["spec_id", "url_key"], "left_anti")


def expand(roots: DataFrame, edges: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """url_id, depth: what is within `most` steps of the roots. A step follows the edges of the layer before it alone, and
    leaves out what was seen; each layer is written once."""
    seen = cut(roots.select("url_id").distinct().withColumn("depth", F.lit(0)), "layer")
    layer = seen
    for k in range(1, most + 1):
        found = layer.join(edges, F.col("url_id") == F.col("from_id")).select(F.col("to_id").alias("url_id")).distinct()
        layer = cut(found.join(seen, "url_id", "left_anti").withColumn("depth", F.lit(k)), "layer")
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)
    return seen


def dense_ids(rows: DataFrame, order: list[str], first: int, id_col: str) -> DataFrame:
    """rows with ids from `first` on, without gaps, in the order of some columns."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut(placed, "placed")
    starts, at = [], first
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return placed.join(starts, "_part").withColumn(id_col, F.col("_start") + F.col("_n")).drop("_part", "_n", "_start")


def feed_links(records: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """New rows for the links of scraped records (url, links, place) and for the pages that they come from: depth 0."""
    both = F.concat(F.array("url"), F.coalesce("links", F.array().cast("array<string>")))  # in one pass: records may come from a parser
    return new_urls(records.select(F.explode(both).alias("url"), "place"), known, "url", "place").withColumns({"depth": F.lit(0), "priority": F.lit(DEFAULT_PRIORITY), "status": F.lit("pending"), "next_crawl_at": now}).drop("n_seen")
