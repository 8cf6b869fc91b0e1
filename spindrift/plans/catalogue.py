"""The queries of the crawl and scrape engine with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fetching, fingerprints, policy
from ..functions import urls as U
from ..operators import attempts as history
from ..operators import extract, frontier, index, neardup, specs
from ..sources import replay
from ..sources.scratch import cut, spread
from . import fixtures as T

NOW = f"TIMESTAMP '{T.NOW}'"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, own: str = ""):  # noqa: ANN201
    """Register a query by its name, with the SELECT that gives its rows from the shared WITH list and its own tables."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {T.SQL}{', ' + own if own else ''} {sql}"
        return f

    return put


@query("SELECT url_key, url, host, n_seen FROM u0")
def url_normalize_dedup(spark: SparkSession, d: str) -> DataFrame:
    return frontier.new_urls(T.pages(spark, d))


@query("SELECT regexp_replace(lower(regexp_extract(url, '://([^/?]*)', 1)), '^www[.]', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def registrable_host_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.pages(spark, d).groupBy(U.registrable_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS origin FROM pages")
def robots_origin(spark: SparkSession, d: str) -> DataFrame:
    return T.pages(spark, d).select("page_id", U.robots_origin(F.col("url")).alias("origin"))


@query(f"SELECT url_key, url, host, url_id AS place, 0 AS depth, 1000 AS priority, 'pending' AS status, strftime({NOW}, '%Y-%m-%d %H:%M:%S') AS next_crawl_at FROM u0 WHERE url_id % 3 <> 0")
def seed_frontier(spark: SparkSession, d: str) -> DataFrame:
    known = T.urls(spark, d).filter("url_id % 3 = 0")
    rows = frontier.seed(T.pages(spark, d), known, T.now(), place_col="page_id")
    return rows.select("url_key", "url", "host", "place", "depth", "priority", "status", T.shown("next_crawl_at"))


@query("SELECT host, coalesce(k, domain_id) AS domain_id FROM hosts LEFT JOIN (SELECT host, 1000000 + min(url_id) AS k FROM u0 WHERE url_id < 10 GROUP BY host) USING (host)")
def domain_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = T.urls(spark, d)
    known = u.filter("url_id < 10").groupBy("host").agg((F.min("url_id") + 1_000_000).alias("domain_id"))
    return frontier.upsert_domains(u.select("host", "url_id"), known, "url_id")


_CLAIM = f"""FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY priority DESC, next_crawl_at, url_id) AS r FROM urls
  WHERE status = 'pending' AND next_crawl_at <= {NOW}) u JOIN domains USING (domain_id) WHERE r = 1"""


def _claimed(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    u = T.urls(spark, d)
    return frontier.claim(u, T.domains(u), T.now(), strict=strict)


@query(f"SELECT url_id, url, u.host, depth, js_required {_CLAIM} ORDER BY domain_id LIMIT 20")
def claim_urls(spark: SparkSession, d: str) -> DataFrame:
    return _claimed(spark, d, False).select("url_id", "url", "host", "depth", "js_required")


@query(f"SELECT url_id, url, u.host, depth, js_required {_CLAIM} AND is_crawlable AND next_available_at <= {NOW} ORDER BY domain_id LIMIT 20")
def claim_urls_strict_gate(spark: SparkSession, d: str) -> DataFrame:
    return _claimed(spark, d, True).select("url_id", "url", "host", "depth", "js_required")


@query(
    f"SELECT url_id, CASE WHEN c THEN 'leased' ELSE status END AS status, CASE WHEN c THEN 'me' ELSE lease_owner END AS lease_owner, strftime(CASE WHEN c THEN {NOW} + to_seconds(300) ELSE lease_expires_at END, '%Y-%m-%d %H:%M:%S') AS lease_expires_at, attempt_count + c::INT AS attempt_count FROM (SELECT urls.*, k.url_id IS NOT NULL AS c FROM urls LEFT JOIN k USING (url_id))",
    f"k AS (SELECT url_id {_CLAIM} ORDER BY domain_id LIMIT 20)",
)
def claim_lease(spark: SparkSession, d: str) -> DataFrame:
    rows = frontier.lease(T.urls(spark, d), _claimed(spark, d, False), "me", T.now())
    return rows.select("url_id", "status", "lease_owner", T.shown("lease_expires_at"), "attempt_count")


@query(
    f"""SELECT target_id, url, host, spec_id, CASE WHEN spec_id % 2 = 0 THEN 'always' ELSE 'auto' END AS spec_render_mode FROM (SELECT t.*, row_number() OVER (PARTITION BY domain_id ORDER BY next_attempt_at, target_id) AS r FROM targets t
  JOIN (SELECT spec_id FROM specs WHERE is_active) USING (spec_id) WHERE status = 'pending' AND next_attempt_at <= {NOW}) t JOIN hosts USING (domain_id) WHERE r = 1 ORDER BY domain_id LIMIT 20"""
)
def claim_scrape_targets(spark: SparkSession, d: str) -> DataFrame:
    u = T.urls(spark, d)
    s = T.specs(spark).withColumn("render_mode", F.when(F.col("spec_id") % 2 == 0, "always"))
    return specs.claim_targets(T.targets(u), s, T.domains(u), T.now(), strict=False).select("target_id", "url", "host", "spec_id", "spec_render_mode")


@query(
    f"SELECT url_id, coalesce(late, false) AS reaped, CASE WHEN late THEN 'pending' ELSE status END AS status, CASE WHEN late THEN NULL ELSE lease_owner END AS lease_owner FROM (SELECT *, status = 'leased' AND lease_expires_at < {NOW} AS late FROM urls)"
)
def reap_expired(spark: SparkSession, d: str) -> DataFrame:
    return frontier.reap(T.urls(spark, d), T.now()).select("url_id", "reaped", "status", "lease_owner")


@query(f"SELECT count(*) AS n FROM targets JOIN urls ON url_id = target_id WHERE urls.status = 'leased' AND lease_expires_at < {NOW}")
def reap_expired_scrape(spark: SparkSession, d: str) -> DataFrame:
    return frontier.reap(T.targets(T.urls(spark, d)), T.now()).agg(F.count_if("reaped").alias("n"))


@query(f"SELECT url_id, coalesce(m, false) AS renewed, strftime(CASE WHEN m THEN {NOW} + to_seconds(300) ELSE lease_expires_at END, '%Y-%m-%d %H:%M:%S') AS lease_expires_at FROM (SELECT *, status = 'leased' AND lease_owner = 'w1' AS m FROM urls)")
def lease_renew(spark: SparkSession, d: str) -> DataFrame:
    return frontier.renew(T.urls(spark, d), F.lit("w1"), T.now()).select("url_id", "renewed", T.shown("lease_expires_at"))


_LEASED = "FROM urls WHERE status = 'leased'"


@query(f"SELECT url_id, CASE WHEN consecutive_failures + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, strftime({NOW} + to_minutes((2 ** least(consecutive_failures, 6))::INT), '%Y-%m-%d %H:%M:%S') AS next_crawl_at, consecutive_failures + 1 AS consecutive_failures {_LEASED}")
def fail_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = frontier.fail(T.urls(spark, d).filter("status = 'leased'"), T.now())
    return rows.select("url_id", "status", T.shown("next_crawl_at"), "consecutive_failures")


@query(f"SELECT url_id, CASE WHEN status = 'leased' THEN 'done' ELSE status END AS status, strftime(CASE WHEN status = 'leased' THEN {NOW} + to_days(7) ELSE next_crawl_at END, '%Y-%m-%d %H:%M:%S') AS next_crawl_at, CASE WHEN status = 'leased' THEN 0 ELSE consecutive_failures END AS consecutive_failures FROM urls")
def complete_state(spark: SparkSession, d: str) -> DataFrame:
    u = T.urls(spark, d)
    done = frontier.complete(u.filter("status = 'leased'"), T.now())
    return frontier.merge(u, done, ["url_id"]).select("url_id", "status", T.shown("next_crawl_at"), "consecutive_failures")


_ETAG = "CASE WHEN url_id % 2 = 0 THEN 'v1' ELSE 'v0' END"


@query(f"SELECT url_id, 'done' AS status, strftime({NOW} + to_days(7), '%Y-%m-%d %H:%M:%S') AS next_crawl_at, 'not_modified' AS outcome {_LEASED} AND url_id % 2 = 0")
def reschedule_304(spark: SparkSession, d: str) -> DataFrame:
    u = T.urls(spark, d).filter("status = 'leased'").withColumn("etag", F.expr(_ETAG))
    answers = replay.from_pages(u.select("url", F.lit("x").alias("html"))).withColumn("etag", F.lit("v1"))
    same = replay.fetch(u, answers).filter("outcome = 'not_modified'")
    return frontier.reschedule(same, T.now()).select("url_id", "status", T.shown("next_crawl_at"), "outcome")


@query(f"SELECT url_id, 'skipped' AS status, NULL::VARCHAR AS lease_owner {_LEASED}")
def skip_state(spark: SparkSession, d: str) -> DataFrame:
    return frontier.skip(T.urls(spark, d).filter("status = 'leased'")).select("url_id", "status", "lease_owner")


@query("SELECT url_id, 'pending' AS status FROM urls WHERE status = 'done' AND next_crawl_at <= " + NOW)
def recrawl_due(spark: SparkSession, d: str) -> DataFrame:
    return frontier.due_for_recrawl(T.urls(spark, d), T.now()).select("url_id", "status")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a parser reads next, dealt out to all cores where the file has fewer row groups."""
    return spread(T.pages(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract_pages(_pages(spark, d), parts=("links",), raw=True).select("page_id", F.posexplode("links").alias("place", "l"))
    return out.select("page_id", "place", "l.*")


@query("SELECT sha256(url) AS url_key, url, (place // 100000 % 4 + 1)::INT AS depth FROM (SELECT url, min(page_id * 100000 + place) AS place FROM links GROUP BY url) WHERE url NOT IN (SELECT url FROM u0)")
def add_links_new_urls(spark: SparkSession, d: str) -> DataFrame:
    found = _links(spark, d).select("url", (F.col("page_id") * 100_000 + F.col("place")).alias("place"), (F.col("page_id") % 4).cast("int").alias("depth"))
    return frontier.add_links(found, T.urls(spark, d), T.now()).select("url_key", "url", "depth")


_DECODED = "replace(replace(replace(trim(label), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"SELECT page_id AS from_url_id, sha256(url) AS to_url_key, arg_min(nullif({_DECODED}, ''), place) AS anchor_text FROM links GROUP BY page_id, url")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    found = cut(_links(spark, d), "links").withColumnRenamed("page_id", "from_url_id")
    targets = found.select("url").distinct().withColumn("url_id", U.url_key(F.col("url")))
    out = frontier.add_edges(found, targets)
    return out.select("from_url_id", F.col("to_url_id").alias("to_url_key"), "anchor_text")


@query(
    "SELECT url_id, min(depth) AS depth FROM walk GROUP BY url_id",
    "edges AS (SELECT url_id // 3 AS from_id, url_id AS to_id FROM urls WHERE url_id // 3 <> url_id AND url_id // 3 IN (SELECT url_id FROM urls)), "
    "walk AS (SELECT url_id, 0 AS depth FROM urls WHERE url_id NOT IN (SELECT to_id FROM edges) UNION SELECT e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.url_id WHERE w.depth < 6)",
)
def depth_frontier(spark: SparkSession, d: str) -> DataFrame:
    """All urls, walked from every one that no other leads to. No page of the tables links to another, so edges follow from the ids."""
    u = cut(T.urls(spark, d).select("url_id"), "urls")
    pairs = u.select(F.floor(F.col("url_id") / 3).alias("from_id"), F.col("url_id").alias("to_id")).filter("from_id <> to_id")
    edges = cut(pairs.join(u.withColumnRenamed("url_id", "from_id"), "from_id", "left_semi"), "edges")
    return frontier.expand(u.join(edges.select(F.col("to_id").alias("url_id")), "url_id", "left_anti"), edges)


_THIN = """regexp_matches(html, '(?i)<(div|main)[^>]+id=["''](root|app|__next|__nuxt)["''][^>]*>\\s*</') OR w < 80"""
_WORDS = "len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::INT"


@query(
    "SELECT host, (js_evidence_count + coalesce(n, 0))::INT AS js_evidence_count, js_required OR (n IS NOT NULL AND js_evidence_count + n >= 3) AS js_required FROM domains "
    f"LEFT JOIN (SELECT {T._HOST} AS host, count(*) AS n FROM (SELECT page_id, html, {_WORDS} AS w FROM pages) JOIN norm USING (page_id) WHERE {_THIN} GROUP BY 1) USING (host)"
)
def js_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence from every page that is too thin without a browser."""
    thin = T.pages(spark, d).filter(fetching.needs_render(F.col("html"))).select(U.registrable_host(U.normalize(F.col("url"))).alias("host"))
    return frontier.js_evidence(T.domains(T.urls(spark, d)), thin).select("host", "js_evidence_count", "js_required")


@query("SELECT domain_id, (10 + n)::BIGINT AS pages_discovered FROM domains JOIN (SELECT domain_id, count(*) AS n FROM urls GROUP BY domain_id) USING (domain_id)")
def domain_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters raised by every url of a domain."""
    u = T.urls(spark, d)
    start = T.domains(u).withColumn("pages_discovered", F.lit(10).cast("long"))
    return frontier.domain_counters(start, u, "pages_discovered").select("domain_id", "pages_discovered")


@query("SELECT id, status_code, CASE WHEN status_code = 403 THEN 'forbidden' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code BETWEEN 500 AND 599 THEN 'server_error' WHEN status_code BETWEEN 400 AND 499 THEN 'client_error' ELSE 'other' END AS error_kind FROM attempts")
def http_error_class(spark: SparkSession, d: str) -> DataFrame:
    return T.attempts(spark, d).select("id", "status_code", fetching.http_error_class(F.col("status_code")).alias("error_kind"))


_MARK = "[" + ", ".join(f"'{m}'" for m, _ in fetching.CHALLENGES) + "]"
_BODY = f"'<p>' || CASE WHEN page_id % 3 = 0 THEN upper({_MARK}[page_id % {len(fetching.CHALLENGES)} + 1]) ELSE '' END || '</p>' || html"


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(b), '{m}') THEN '{k}'" for m, k in fetching.CHALLENGES) + f" END AS challenge FROM (SELECT page_id, {_BODY} AS b FROM pages)")
def challenge_detect(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array(*[F.lit(m) for m, _ in fetching.CHALLENGES])
    mark = F.when(F.col("page_id") % 3 == 0, F.upper(F.element_at(marks, (F.col("page_id") % len(fetching.CHALLENGES) + 1).cast("int")))).otherwise("")
    body = F.concat(F.lit("<p>"), mark, F.lit("</p>"), "html")
    return T.pages(spark, d).select("page_id", fetching.challenge_type(body).alias("challenge"))


@query(f"SELECT page_id, {_THIN} AS needs_render, w AS visible_words FROM (SELECT page_id, html, {_WORDS} AS w FROM pages)")
def needs_render(spark: SparkSession, d: str) -> DataFrame:
    return T.pages(spark, d).select("page_id", fetching.needs_render(F.col("html")).alias("needs_render"), fetching.visible_words(F.col("html")).alias("visible_words"))


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'network_error' WHEN s = 304 THEN 'not_modified' WHEN s >= 400 THEN 'http_error' WHEN page_id % 5 = 0 THEN 'non_html' ELSE 'ok' END AS outcome FROM (SELECT page_id, [200, 304, 404, 200][page_id % 4 + 1] AS s FROM pages)")
def fetch_outcome(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 304, 404, 200))), (i % 4 + 1).cast("int"))
    kind = F.when(i % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    return T.pages(spark, d).select("page_id", fetching.outcome(status, kind, F.octet_length("html"), F.when(i % 7 == 0, "ConnectError")).alias("outcome"))


@query("SELECT page_id, least(greatest(coalesce(CASE WHEN page_id % 3 <> 0 THEN page_id * 173 END, 1000), 500), 30000)::INT AS crawl_delay_ms FROM pages")
def crawl_delay_clamp(spark: SparkSession, d: str) -> DataFrame:
    declared = F.when(F.col("page_id") % 3 != 0, F.col("page_id") * 173)
    return T.pages(spark, d).select("page_id", policy.clamp_delay(declared).cast("int").alias("crawl_delay_ms"))


@query("SELECT url_id, CASE WHEN domain_id % 4 = 0 THEN false WHEN domain_id % 4 = 1 THEN NOT regexp_matches(url, '://[^/]*/(en|es)/') WHEN domain_id % 4 = 2 THEN true ELSE false END AS allowed FROM urls")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    u = T.urls(spark, d)
    return policy.robots_allowed(u.select("url_id", "host", "url"), _robots(u)).select("url_id", "allowed")


def _robots(u: DataFrame) -> DataFrame:
    """Policies of three in four hosts: refused, with rules, without any; the fourth has no answer."""
    k = F.col("domain_id") % 4
    rules = "User-agent: *\nDisallow: /en/\nDisallow: /es/\nCrawl-delay: 2"
    answers = T.domains(u).filter(k != 3).select("host", F.when(k == 1, rules).alias("body"), F.when(k == 0, 403).when(k == 1, 200).otherwise(404).alias("status"))
    return replay.robots(answers)


@query("SELECT host, NOT k IN (0, 3) AS is_crawlable, CASE WHEN k = 1 THEN 2000 ELSE 1000 END AS crawl_delay_ms, k <> 3 AS is_final FROM (SELECT host, domain_id % 4 AS k FROM domains)")
def robots_refresh(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("domain_id") % 4
    rules = "User-agent: *\nDisallow: /en/\nCrawl-delay: 2"
    answers = T.domains(T.urls(spark, d)).select("host", F.when(k == 1, rules).alias("body"), F.when(k == 0, 401).when(k == 1, 200).when(k == 2, 410).otherwise(503).alias("status"))
    return replay.robots(answers).select("host", "is_crawlable", "crawl_delay_ms", "is_final")


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_sha256_dups(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return docs.groupBy("content_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS word_count FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"))


@query()
def simhash_blake2b(spark: SparkSession, d: str) -> DataFrame:
    return spread(T.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", fingerprints.simhash("text").alias("simhash"))


_SIMHASH = """tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents),
sh AS (SELECT doc_id, array_to_string(t[i:i + 3], '') AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM tok WHERE len(t) > 0)),
hs AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM sh),
vt AS (SELECT doc_id, b, 2 * sum((h >> b::UBIGINT) & 1::UBIGINT) > count(*) AS yes FROM hs, (SELECT unnest(range(64)) AS b) GROUP BY doc_id, b),
sim AS (SELECT documents.doc_id, coalesce((CASE WHEN v >= 9223372036854775808::HUGEINT THEN v - 18446744073709551616::HUGEINT ELSE v END)::BIGINT, 0) AS simhash FROM documents
  LEFT JOIN (SELECT doc_id, sum(CASE WHEN yes THEN (1::HUGEINT << b::INT) ELSE 0 END)::HUGEINT AS v FROM vt GROUP BY doc_id) USING (doc_id))"""
_CLOSE = ", close AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sim a JOIN sim b ON a.doc_id <> b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3"


def _simhashes(spark: SparkSession, d: str) -> DataFrame:
    """Written once: what follows reads it several times."""
    return cut(simhash_md5(spark, d), "simhashes")


@query("SELECT doc_id, simhash FROM sim", _SIMHASH)
def simhash_md5(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.simhash_md5(spread(T.table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


@query("SELECT a.simhash AS a, b.simhash AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM s a JOIN s b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3", _SIMHASH + ", s AS (SELECT DISTINCT simhash FROM sim)")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.close_fingerprints(_simhashes(spark, d))
    return pairs.withColumn("distance", fingerprints.hamming(F.col("a"), F.col("b")))


@query("SELECT a AS doc_id, min(b) AS duplicate_of FROM close GROUP BY a", _SIMHASH + _CLOSE + " AND (a.simhash >> 56) = (b.simhash >> 56))")
def near_dup_bucket(spark: SparkSession, d: str) -> DataFrame:
    return neardup.any_duplicates(_simhashes(spark, d), "doc_id", banded=False)


@query("SELECT a AS doc_id, min(b) AS duplicate_of FROM close GROUP BY a", _SIMHASH + _CLOSE + ")")
def near_dup_banded(spark: SparkSession, d: str) -> DataFrame:
    return neardup.any_duplicates(_simhashes(spark, d), "doc_id")


@query("SELECT doc_id, CASE WHEN o IS NULL THEN 'indexed' ELSE 'suppressed' END AS index_state, o AS duplicate_of FROM documents LEFT JOIN (SELECT a AS doc_id, min(b) AS o FROM close WHERE b < a GROUP BY a) USING (doc_id)", _SIMHASH + _CLOSE + ")")
def index_drain(spark: SparkSession, d: str) -> DataFrame:
    docs = _simhashes(spark, d).withColumn("index_state", F.lit("pending"))
    return index.drain(docs, T.now(), "doc_id").select("doc_id", "index_state", "duplicate_of")


@query("SELECT doc_id, lang, substr(text, 1, 50000) AS content FROM documents")
def index_payload(spark: SparkSession, d: str) -> DataFrame:
    return index.payload(T.table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")


@query("SELECT token, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, 50000)), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY ALL")
def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(index.payload(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id * 7919 % 1009, doc_id LIMIT 200")
def index_pending(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", F.lit("pending").alias("index_state"), (F.col("doc_id") * 7919 % 1009).alias("updated_at"))
    return index.pending(docs, id_col="doc_id").select("doc_id")


def _plain(text: str) -> str:
    """SQL: the test pages' entities as characters."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{c}')"
    return text


_TITLE = _plain("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")
_LANG = "lower(split_part(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '-', 1))"
#: The test pages' content is their one article, which holds no boilerplate.
_TEXT = "trim(regexp_replace(" + _plain("regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@query(
    f"SELECT page_id, url, url AS canonical_url, title, NULL::VARCHAR AS description, text, lang, len(string_split(text, ' '))::INT AS word_count, sha256(text) AS content_sha256 FROM (SELECT page_id, url, {_TITLE} AS title, {_LANG} AS lang, {_TEXT} AS text FROM pages)"
)
def extract_docs(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_pages(_pages(spark, d), parts=("canonical_url", "title", "description", "text", "lang"))


@query(f"SELECT page_id, {_TITLE} AS title, {_LANG} AS lang FROM pages")
def extract_title_lang(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_pages(_pages(spark, d), parts=("title", "lang")).select("page_id", "title", "lang")


#: A specification with nested, repeated and attribute fields, by both kinds of selectors.
PAGE_FIELDS = json.dumps([{"name": "title", "selector": "title"}, {"name": "lang", "selector": "//html/@lang", "selector_type": "xpath"}, {"name": "hrefs", "selector": "nav a[href]", "attr": "href", "many": True}, {"name": "items", "selector": "nav li", "many": True, "fields": [{"name": "label", "selector": "a"}, {"name": "to", "selector": "a", "attr": "href"}]}, {"name": "none", "selector": "#absent"}])


_ITEM = "struct<label: string, to: string>"


@query(
    f"""SELECT p.page_id, {_TITLE} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, string_agg(o || href, ' ' ORDER BY place) AS hrefs,
  string_agg({_plain("trim(anchors.label)")} || '>' || o || href, ' ' ORDER BY place) AS items, true AS has_none, string_agg(l.url, ' ' ORDER BY place) AS links
  FROM (SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS o FROM pages) p JOIN anchors USING (page_id) JOIN links l USING (page_id, place) GROUP BY ALL"""
)
def scrape_records(spark: SparkSession, d: str) -> DataFrame:
    """The fields of every record, read back from its JSON, and its links."""
    rows = extract.scrape_pages(_pages(spark, d), PAGE_FIELDS, "hrefs").filter("size(links) > 0")
    data = F.from_json("data", f"title string, lang string, hrefs array<string>, items array<{_ITEM}>, none string")
    rows = rows.select("page_id", data.alias("r"), "links")
    items = F.transform("r.items", lambda x: F.concat(F.trim(x.label), F.lit(">"), x.to))
    return rows.select("page_id", "r.title", "r.lang", F.array_join("r.hrefs", " ").alias("hrefs"), F.array_join(items, " ").alias("items"), F.col("r.none").isNull().alias("has_none"), F.array_join("links", " ").alias("links"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(split_part(html, '</nav>', 1), '<a href='))::INT AS n_links FROM pages")
def scrape_nav(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.scrape_pages(_pages(spark, d), PAGE_FIELDS, "hrefs")
    data = F.from_json("data", "lang string, hrefs array<string>")
    return rows.select("page_id", data.lang.alias("lang"), F.size(data.hrefs).alias("n_links"))


@query("SELECT spec_id, url, url_key, domain_id FROM urls JOIN specs ON is_active AND feed_from_crawler AND (host_pattern IS NULL OR host_pattern = host) AND (path_regex IS NULL OR regexp_matches(url, path_regex))")
def enroll_targets(spark: SparkSession, d: str) -> DataFrame:
    return frontier.enroll(T.urls(spark, d), T.specs(spark))


@query("SELECT sha256(url) AS url_key, url, 0 AS depth, 100 AS priority FROM (SELECT url FROM links UNION SELECT url FROM norm WHERE page_id IN (SELECT page_id FROM links)) WHERE url NOT IN (SELECT url FROM u0 WHERE url_id % 2 = 0)")
def feed_links(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.scrape_pages(_pages(spark, d), json.dumps([{"name": "all", "selector": "a[href]", "attr": "href", "many": True}]), "all", raw=True).filter("size(links) > 0")
    fed = frontier.feed_links(rows.withColumnRenamed("page_id", "place"), T.urls(spark, d).filter("url_id % 2 = 0"), T.now())
    return fed.select("url_key", "url", "depth", "priority")


@query("SELECT name, max(version) AS version, arg_max(spec_id, version)::BIGINT AS spec_id FROM specs GROUP BY name")
def latest_spec(spark: SparkSession, d: str) -> DataFrame:
    return specs.latest(T.specs(spark)).select("name", "version", "spec_id")


@query("SELECT target_id, url, data FROM records JOIN targets USING (target_id) WHERE records.spec_id = 5 ORDER BY extracted_at DESC, target_id LIMIT 100")
def records_list_topn(spark: SparkSession, d: str) -> DataFrame:
    t = T.targets(T.urls(spark, d))
    return specs.newest_records(T.records(t), t, 5).select("target_id", "url", "data")


@query("SELECT DISTINCT sha256(url) AS url_key, url FROM norm WHERE url NOT IN (SELECT url FROM targets WHERE spec_id = 2)")
def submit_targets(spark: SparkSession, d: str) -> DataFrame:
    raw = T.pages(spark, d).select("url", F.col("page_id").alias("place"))
    return specs.submit(2, raw, T.targets(T.urls(spark, d)), T.now()).select("url_key", "url")


@query("SELECT strftime(date_trunc('month', started_at), '%Y-%m-%d') AS started_month, count(*) AS n_attempts, count(error_class) AS n_errors FROM attempts GROUP BY 1")
def attempts_by_month(spark: SparkSession, d: str) -> DataFrame:
    return history.by_month(T.attempts(spark, d)).withColumn("started_month", F.col("started_month").cast("string"))


@query("SELECT id FROM attempts WHERE date_trunc('month', started_at) >= DATE '2024-03-01'")
def attempts_retention(spark: SparkSession, d: str) -> DataFrame:
    a = T.attempts(spark, d)
    return a.filter(history.kept(history.month(F.col("started_at")), F.lit("2024-04-17 00:00:00").cast("timestamp"))).select("id")


@query("SELECT outcome, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, " + ", ".join(f"count(*) FILTER (duration_ms <= {b}) AS le_{b}" for b in history.DURATION_BUCKETS) + " FROM attempts GROUP BY outcome")
def outcome_metrics(spark: SparkSession, d: str) -> DataFrame:
    return history.metrics(T.attempts(spark, d))


@query("SELECT url_id, 'raw/' || substr(sha256(url_id::VARCHAR), 1, 2) || '/' || host || '/' || url_id || '.html.zst' AS raw_key, 'text/' || substr(sha256(url_id::VARCHAR), 1, 2) || '/' || host || '/' || url_id || '.txt.zst' AS text_key FROM urls")
def blob_keys(spark: SparkSession, d: str) -> DataFrame:
    u, i = T.urls(spark, d), F.col("url_id")
    return u.select("url_id", extract.blob_key("raw", F.col("host"), i, "html").alias("raw_key"), extract.blob_key("text", F.col("host"), i, "txt").alias("text_key"))


@query(
    # No two of the pages that a round over the test tables fetches are near duplicates, so that none is suppressed here.
    f"""SELECT url_id, url, {_TITLE} AS title, NULL::VARCHAR AS description, {_LANG} AS lang, substr({_TEXT}, 1, 50000) AS content
  FROM (SELECT u.url_id, u.url, domain_id {_CLAIM} AND is_crawlable AND next_available_at <= {NOW}) JOIN (SELECT page_id AS url_id, html FROM pages) USING (url_id)
  WHERE domain_id % 4 = 2 OR (domain_id % 4 = 1 AND NOT regexp_matches(url, '://[^/]*/(en|es)/'))"""
)
def crawl_round(spark: SparkSession, d: str) -> DataFrame:
    """Claim, fetch, extract, suppress near duplicates and make the index payload, for the best due url of every domain that may be crawled."""
    u = cut(T.urls(spark, d), "urls")
    claimed = frontier.claim(u, T.domains(u), T.now(), batch=None)
    pages = T.pages(spark, d)
    first = pages.join(u.select(F.col("url_id").alias("page_id")), "page_id", "left_semi")  # of pages with one url, the first
    answers = replay.from_pages(first).withColumn("url", U.normalize(F.col("url")))
    fetched = replay.fetch_allowed(claimed, answers, _robots(u)).filter(fetching.has_body(F.col("outcome"), F.octet_length("body")))
    docs = cut(extract.extract_pages(fetched.select("url_id", "host", "url", F.col("body").alias("html"))).drop("links"), "extracted")
    drained = index.drain(docs.withColumn("index_state", F.lit("pending")), T.now())
    return index.payload(drained.filter("index_state = 'indexed'").select("url_id", "url", "title", "description", "lang", "text"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return crawl_round(spark, d)
