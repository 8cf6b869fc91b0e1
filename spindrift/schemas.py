"""Tables, enumerations and constants of the crawl and scrape engine."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _H, _S, _B, _TS, _BIN = T.LongType(), T.IntegerType(), T.ShortType(), T.StringType(), T.BooleanType(), T.TimestampType(), T.BinaryType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


DOMAINS = _table(
    domain_id=_L, host=_S, scheme_hint=_S, robots_body=_S, robots_fetched_at=_TS, robots_expires_at=_TS, robots_status=_H, crawl_delay_ms=_I, is_crawlable=_B, block_reason=_S,
    next_available_at=_TS, js_required=_B, js_evidence_count=_I, avg_latency_ms=_I, pages_discovered=_L, pages_crawled=_L, error_count=_L, created_at=_TS,
)
URLS = _table(
    url_id=_L, domain_id=_L, url=_S, url_key=_S, depth=_I, priority=_I, status=_S, lease_owner=_S, lease_expires_at=_TS, discovered_at=_TS, last_crawled_at=_TS, next_crawl_at=_TS,
    last_status_code=_H, attempt_count=_I, consecutive_failures=_I, etag=_S, last_modified=_S, content_sha256=_S, simhash=_L, render_mode=_S,
)
LINKS = _table(from_url_id=_L, to_url_id=_L, anchor_text=_S, rel=_S, first_seen_at=_TS)
DOCUMENTS = _table(url_id=_L, title=_S, description=_S, lang=_S, word_count=_I, raw_key=_S, text_key=_S, index_state=_S, indexed_at=_TS, duplicate_of=_L, updated_at=_TS)
CRAWL_ATTEMPTS = _table(id=_L, url_id=_L, started_at=_TS, duration_ms=_I, status_code=_H, render_mode=_S, bytes=_L, error_class=_S, challenge_type=_S, error_detail=_S, worker_id=_S)
SCRAPE_SPECS = _table(spec_id=_L, name=_S, version=_I, fields=_S, render_mode=_S, link_field=_S, feed_to_crawler=_B, feed_from_crawler=_B, host_pattern=_S, path_regex=_S, is_active=_B, created_at=_TS)
SCRAPE_TARGETS = _table(
    target_id=_L, spec_id=_L, domain_id=_L, url=_S, url_key=_S, status=_S, lease_owner=_S, lease_expires_at=_TS, discovered_at=_TS, last_attempted_at=_TS, next_attempt_at=_TS,
    last_status_code=_H, attempt_count=_I, consecutive_failures=_I, etag=_S, last_modified=_S,
)
SCRAPED_RECORDS = _table(target_id=_L, spec_id=_L, data=_S, raw_key=_S, extracted_at=_TS, updated_at=_TS)
FETCH_RESULTS = _table(
    url_id=_L, url=_S, outcome=_S, status_code=_I, final_url=_S, headers=T.MapType(_S, _S), challenge_type=_S, body=_BIN, content_type=_S, encoding=_S, etag=_S, last_modified=_S,
    render_mode=_S, duration_ms=_I, error_class=_S, error_detail=_S,
)

#: States and outcomes.
URL_STATUS = ("pending", "leased", "done", "failed", "skipped")
SCRAPE_STATUS = URL_STATUS
INDEX_STATE = ("pending", "indexed", "failed", "suppressed")
RENDER_MODE = ("static", "rendered")
SPEC_RENDER_MODE = ("auto", "always", "never")
FETCH_OUTCOME = ("ok", "not_modified", "robots_denied", "http_error", "network_error", "non_html", "too_large", "storage_error")

#: Limits and intervals.
BATCH_SIZE, LEASE_SECONDS, MAX_FAILURES, MAX_DEPTH = 20, 300, 5, 6
RECRAWL_DAYS, BACKOFF_MINUTES, BACKOFF_DOUBLINGS = 7, 1, 6
DEFAULT_PRIORITY, SEED_PRIORITY = 100, 1000
ROBOTS_TTL_HOURS = 24
CRAWL_DELAY_DEFAULT_MS, CRAWL_DELAY_MIN_MS, CRAWL_DELAY_MAX_MS = 1000, 500, 30_000
JS_EVIDENCE = 3
MAX_BODY_BYTES = 5 * 1024 * 1024
MIN_STATIC_WORDS = 80
INDEX_BATCH, INDEX_CONTENT_CHARS = 200, 50_000
DUPLICATE_BITS, BUCKET_BITS, SIMHASH_TOKENS = 3, 8, 4
USER_AGENT = "MyCrawler/0.1 (+https://example.org/crawler; contact@example.org)"
