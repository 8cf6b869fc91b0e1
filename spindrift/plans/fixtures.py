"""Engine tables made from the test tables, by rules that SQL can repeat.

A url's id is the smallest page that has it, a domain's the smallest id of its urls; queue states follow from the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import TRACKING
from ..operators.frontier import new_urls, upsert_domains

NOW = "2026-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def shown(c: str) -> Column:
    """A time as text, alike in any session's zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = new_urls(pages(spark, sf_dir), None, "url", "page_id").drop("n_seen").withColumnRenamed("place", "url_id")
    none = spark.createDataFrame([], "host string, domain_id long")
    u = u.join(upsert_domains(u, none, "url_id"), "host")
    i = F.col("url_id")
    u = u.withColumn("status", F.when(i % 5 < 3, "pending").when(i % 5 == 3, "leased").otherwise("done"))
    leased = F.col("status") == "leased"
    return u.withColumns(
        {
            "depth": (i % 4).cast("int"),
            "priority": (100 + 10 * (i % 3)).cast("int"),
            "next_crawl_at": now() + _seconds((i % 7 - 5) * 3600),
            "attempt_count": (i % 4).cast("int"),
            "consecutive_failures": (i % 6).cast("int"),
            "lease_owner": F.when(leased, F.concat(F.lit("w"), (i % 4).cast("string"))),
            "lease_expires_at": F.when(leased, now() + _seconds(F.when(i % 2 == 0, F.lit(-60)).otherwise(F.lit(3600)))),
        }
    )


def domains(u: DataFrame) -> DataFrame:
    d, i = u.select("host", "domain_id").distinct(), F.col("domain_id")
    return d.withColumns({"is_crawlable": i % 4 != 3, "next_available_at": now() + _seconds((i % 3 - 1) * 60), "js_required": i % 5 == 0, "js_evidence_count": (i % 3).cast("int"), "crawl_delay_ms": F.lit(1000)})


#: Specifications as rows: id, name, version, host, pattern, whether they take crawled pages, whether they are active.
SPECS = [
    (1, "articles", 1, None, "/en/", True, True),
    (2, "articles", 2, None, "/(en|fr)/[0-9]*5", True, True),
    (3, "site", 1, "tionsh.example.net", None, True, True),
    (4, "site", 2, "tionsh.example.net", "/de/", True, False),
    (5, "all", 1, None, None, False, True),
    (6, "spanish", 1, None, "/es/", True, True),
]
SPEC_COLUMNS = "spec_id long, name string, version int, host_pattern string, path_regex string, feed_from_crawler boolean, is_active boolean"


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, SPEC_COLUMNS)


def targets(u: DataFrame) -> DataFrame:
    """A target for each url: its spec, state and times from its id."""
    i = F.col("url_id")
    return u.select(i.alias("target_id"), (i % 6 + 1).alias("spec_id"), "domain_id", "url", "url_key", "status", F.col("next_crawl_at").alias("next_attempt_at"), "attempt_count", "lease_owner", "lease_expires_at", "consecutive_failures")


def records(t: DataFrame) -> DataFrame:
    i = F.col("target_id")
    return t.filter("status = 'done'").select("target_id", "spec_id", F.concat(F.lit('{"n": '), i.cast("string"), F.lit("}")).alias("data"), (now() - _seconds(i * 37 % 1009)).alias("extracted_at"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("id"),
        F.col("user_id").alias("url_id"),
        (F.col("ts") + F.make_dt_interval(days=(i % 5 * 30).cast("int"))).alias("started_at"),
        F.floor(F.col("value") * 10).alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, (403, 404, 429, 500, 503))), (i % 5 + 1).cast("int"))).otherwise(200).alias("status_code"),
        F.when(F.col("event_type") == "error", "http_error").otherwise("ok").alias("outcome"),
        F.when(F.col("event_type") == "error", "HTTPStatusError").alias("error_class"),
    )


def _sql_url(url: str) -> str:
    bare = f"regexp_replace({url}, '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[A-Za-z]+://([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({bare}, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '(?i)/(index|default)\\.(html?|php|aspx?)$', '/'), '/+$', '')"
    pairs = f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^({TRACKING})$')))"
    return f"""lower(regexp_extract({bare}, '^([A-Za-z]+)://', 1)) || '://' || {host} || (CASE WHEN {path} = '' THEN '/' ELSE {path} END)
    || (CASE WHEN len({pairs}) = 0 THEN '' ELSE '?' || array_to_string({pairs}, '&') END)"""


_HOST = "regexp_extract(url, '://([^/?]*)', 1)"
#: WITH list of the tables above.
SQL = f"""norm AS (SELECT page_id, {_sql_url("url")} AS url FROM pages),
u0 AS (SELECT sha256(url) AS url_key, url, {_HOST} AS host, min(page_id) AS url_id, count(*) AS n_seen FROM norm GROUP BY url),
hosts AS (SELECT host, min(url_id) AS domain_id FROM u0 GROUP BY host),
urls AS (SELECT u0.* EXCLUDE n_seen, domain_id,
  CASE WHEN url_id % 5 < 3 THEN 'pending' WHEN url_id % 5 = 3 THEN 'leased' ELSE 'done' END AS status,
  (url_id % 4)::INT AS depth, (100 + 10 * (url_id % 3))::INT AS priority,
  TIMESTAMP '{NOW}' + to_seconds((url_id % 7 - 5) * 3600) AS next_crawl_at,
  (url_id % 4)::INT AS attempt_count, (url_id % 6)::INT AS consecutive_failures,
  CASE WHEN url_id % 5 = 3 THEN 'w' || (url_id % 4) END AS lease_owner,
  CASE WHEN url_id % 5 = 3 THEN TIMESTAMP '{NOW}' + to_seconds(CASE WHEN url_id % 2 = 0 THEN -60 ELSE 3600 END) END AS lease_expires_at
  FROM u0 JOIN hosts USING (host)),
domains AS (SELECT host, domain_id, domain_id % 4 <> 3 AS is_crawlable, TIMESTAMP '{NOW}' + to_seconds((domain_id % 3 - 1) * 60) AS next_available_at,
  domain_id % 5 = 0 AS js_required, (domain_id % 3)::INT AS js_evidence_count FROM hosts),
specs(spec_id, name, version, host_pattern, path_regex, feed_from_crawler, is_active) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in s) + ")" for s in SPECS)}),
targets AS (SELECT url_id AS target_id, url_id % 6 + 1 AS spec_id, domain_id, url, url_key, status, next_crawl_at AS next_attempt_at, attempt_count FROM urls),
records AS (SELECT target_id, spec_id, '{{"n": ' || target_id || '}}' AS data, TIMESTAMP '{NOW}' - to_seconds(target_id * 37 % 1009) AS extracted_at FROM targets WHERE status = 'done'),
attempts AS (SELECT event_id AS id, user_id AS url_id, ts + to_days((event_id % 5 * 30)::INT) AS started_at, floor(value * 10)::BIGINT AS duration_ms,
  CASE WHEN event_type = 'error' THEN [403, 404, 429, 500, 503][event_id % 5 + 1] ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' THEN 'http_error' ELSE 'ok' END AS outcome, CASE WHEN event_type = 'error' THEN 'HTTPStatusError' END AS error_class FROM events),
anchors AS (SELECT page_id, n.url AS base, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"[^>]*>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="/[^"]*"[^>]*>([^<]*)</a>', 1)) AS label,
  unnest(range(len(regexp_extract_all(html, '<a href="(/[^"]*)"[^>]*>', 1)))) AS place FROM pages JOIN norm n USING (page_id)),
links AS (SELECT page_id, place, label, regexp_extract(base, '^([a-z]+://[^/?]*)', 1) || (CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END) AS url FROM anchors)"""


