"""Robots policy: what a robots.txt answer means, and whether a URL may be fetched."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CRAWL_DELAY_DEFAULT_MS, CRAWL_DELAY_MAX_MS, CRAWL_DELAY_MIN_MS, ROBOTS_TTL_HOURS, USER_AGENT

RULE = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("allow", T.BooleanType())])
POLICY = T.StructType([T.StructField("is_crawlable", T.BooleanType()), T.StructField("crawl_delay_ms", T.IntegerType()), T.StructField("is_final", T.BooleanType()), T.StructField("has_rules", T.BooleanType()), T.StructField("rules", T.ArrayType(RULE))])


def clamp_delay(ms: Column) -> Column:
    """A crawl delay in milliseconds within its bounds; the default where none is declared."""
    return F.least(F.greatest(F.coalesce(ms, F.lit(CRAWL_DELAY_DEFAULT_MS)), F.lit(CRAWL_DELAY_MIN_MS)), F.lit(CRAWL_DELAY_MAX_MS))


def _rules(body: str | None) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse((body or "").splitlines())
    return rules


def read_robots(host: str, body: str | None, status: int) -> tuple[bool, int, bool, bool]:
    """(is_crawlable, crawl_delay_ms, is_final, has_rules). An answer that is not final is fetched again at once."""
    if status in (401, 403):
        return False, CRAWL_DELAY_DEFAULT_MS, True, False
    if status >= 500:
        return False, CRAWL_DELAY_DEFAULT_MS, False, False
    if status in (404, 410) or not body:
        return True, CRAWL_DELAY_DEFAULT_MS, True, True
    rules = _rules(body)
    delay, rate = rules.crawl_delay(USER_AGENT), rules.request_rate(USER_AGENT)
    ms = int(float(delay) * 1000) if delay else int(rate.seconds / rate.requests * 1000) if rate and rate.requests > 0 else CRAWL_DELAY_DEFAULT_MS
    return rules.can_fetch(USER_AGENT, f"https://{host}/"), min(max(ms, CRAWL_DELAY_MIN_MS), CRAWL_DELAY_MAX_MS), True, True


def own_rules(body: str | None) -> list[tuple[str, bool]]:
    """(prefix, allow) of the rules that a robots.txt has for this crawler, in order; the first whose prefix fits counts."""
    rules = _rules(body)
    entry = next((e for e in rules.entries if e.applies_to(USER_AGENT)), rules.default_entry)
    return [("" if r.path == "*" else r.path, r.allowance) for r in entry.rulelines] if entry else []


@F.pandas_udf(POLICY)
def _read_udf(host: pd.Series, body: pd.Series, status: pd.Series) -> pd.DataFrame:
    rows = [read_robots(h, b, int(s)) for h, b, s in zip(host, body, status, strict=True)]
    return pd.DataFrame([(*r, own_rules(b) if r[3] else []) for r, b in zip(rows, body, strict=True)], columns=POLICY.names)


def parse_robots(robots: DataFrame) -> DataFrame:
    """host, body, status with is_crawlable, crawl_delay_ms, is_final, has_rules and rules: each answer is parsed once."""
    p = _read_udf("host", "body", F.coalesce("status", F.lit(599)))
    return robots.withColumn("_p", p).select(*robots.columns, "_p.*")


#: URLs whose part that rules look at is the path as it stands.
SIMPLE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/|/[A-Za-z0-9_.~-][A-Za-z0-9_.~/-]*)?$"


@F.pandas_udf(T.StringType())
def _matched_udf(url: pd.Series) -> pd.Series:
    def part(u: str) -> str:
        x = urlparse(unquote(u))
        return quote(urlunparse(("", "", x.path, x.params, x.query, x.fragment))) or "/"

    return url.map(part, na_action="ignore")


def matched_part(url: Column) -> Column:
    """What the rules' prefixes are compared with: path, query and fragment, quoted alike; built in for simple URLs."""
    simple = F.coalesce(url.rlike(SIMPLE), F.lit(False))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$", 1)
    return F.when(simple, F.when(path == "", "/").otherwise(path)).otherwise(_matched_udf(F.when(~simple, url)))


def is_stale(fetched_at: Column, now: Column) -> Column:
    return fetched_at.isNull() | (now - fetched_at > F.expr(f"interval {ROBOTS_TTL_HOURS} hours"))


def robots_allowed(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """urls (host, url) with `allowed`: the host's policy (host, is_crawlable, has_rules, rules) applied, closed if unknown.

    Answers were parsed once a host; a url meets its host's few prefixes, never the text that they came from.
    """
    known = policies.select("host", F.col("is_crawlable").alias("_open"), F.col("has_rules").alias("_known"), F.col("rules").alias("_rules"))
    out = urls.join(known, "host", "left").withColumn("_part", matched_part(F.col("url")))
    first = F.try_element_at(F.filter("_rules", lambda r: F.startswith(F.col("_part"), r.prefix)), F.lit(1))
    can = F.col("url").isNotNull() & F.coalesce(first.allow, F.lit(True))
    return out.withColumn("allowed", F.coalesce(F.col("_open") & F.col("_known") & can, F.lit(False))).drop("_open", "_known", "_rules", "_part")


def hosts_to_refresh(domains: DataFrame, now: Column) -> DataFrame:
    """The domains whose robots answer is missing, was not final, or is older than it may be."""
    return domains.filter(is_stale(F.col("robots_fetched_at"), now))


def refresh(domains: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """domains with new answers (host, body, status) put in; one that is not final leaves the domain stale."""
    new = parse_robots(answers.select("host", "body", F.coalesce("status", F.lit(599)).alias("status")))
    new = new.select("host", F.struct("body", "status", "is_crawlable", "crawl_delay_ms", "is_final").alias("_n"))
    out = domains.join(new, "host", "left")
    put = {
        "robots_body": F.col("_n.body"),
        "robots_status": F.col("_n.status").cast("short"),
        "robots_fetched_at": F.when(F.col("_n.is_final"), now),
        "robots_expires_at": F.when(F.col("_n.is_final"), now + F.expr(f"interval {ROBOTS_TTL_HOURS} hours")),
        "crawl_delay_ms": F.col("_n.crawl_delay_ms"),
        "is_crawlable": F.col("_n.is_crawlable"),
    }
    return out.withColumns({k: F.when(F.col("_n").isNotNull(), v).otherwise(F.col(k)) for k, v in put.items()}).drop("_n")
