"""Sources: recorded pages in place of the network, robots answers, seeds and specification files."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fetching import challenge_type, has_body, needs_render, outcome
from ..functions.policy import parse_robots, robots_allowed
from ..operators.specs import validate

RESPONSES = "url string, status int, content_type string, etag string, last_modified string, body string, error_class string, duration_ms int"


def from_pages(pages: DataFrame) -> DataFrame:
    """Recorded pages (url, html) as answers of status 200."""
    return pages.select("url", F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error_class"), F.lit(0).alias("duration_ms"))


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text by the charset that their content type declares; UTF-8 where it declares none that is known."""

    def read(b: bytes | None, kind: str | None) -> str | None:
        if b is None:
            return None
        m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind or "", re.IGNORECASE)
        try:
            return bytes(b).decode(m[1] if m else "utf-8", "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([read(b, k) for b, k in zip(body, content_type, strict=True)], dtype=object)


def http_time(value: Column) -> Column:
    """The time of a Last-Modified header; null where it is none."""
    return F.try_to_timestamp(F.regexp_extract(value, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


def fetch(tasks: DataFrame, responses: DataFrame, render_mode: str = "static", expect_html: bool = True) -> DataFrame:
    """tasks (url, and an etag or last_modified where known) with the outcome of their fetch from recorded responses.

    A task whose etag the response still has, or without an etag one whose page has not changed since its last_modified,
    is not modified and gets no body; one without a response is a network error. Bodies may be text or bytes.
    """
    for c in ("etag", "last_modified"):
        if c not in tasks.columns:
            tasks = tasks.withColumn(c, F.lit(None).cast("string"))
    body = decoded("body", "content_type") if isinstance(responses.schema["body"].dataType, T.BinaryType) else F.col("body")
    size = F.octet_length("body").alias("body_bytes")
    detail = F.col("error_detail") if "error_detail" in responses.columns else F.lit(None).cast("string")
    r = responses.select("url", F.col("status").alias("status_code"), "content_type", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_last_modified"), size, body.alias("body"), "error_class", detail.alias("error_detail"), "duration_ms")
    out = tasks.join(r, "url", "left")
    missing = F.col("status_code").isNull() & F.col("error_class").isNull()
    out = out.withColumns({"error_class": F.when(missing, "ConnectError").otherwise(F.col("error_class")), "error_detail": F.when(missing, "no recorded answer").otherwise(F.col("error_detail"))})
    unchanged = F.coalesce(http_time(F.col("new_last_modified")) <= http_time(F.col("last_modified")), F.col("new_last_modified") == F.col("last_modified"))
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("new_etag")).otherwise(unchanged)
    out = out.withColumn("status_code", F.when(same, 304).otherwise(F.col("status_code")))
    out = out.withColumn("outcome", outcome(F.col("status_code"), F.col("content_type"), F.col("body_bytes"), F.col("error_class"), expect_html))
    shown = F.col("outcome").isin("ok", "http_error")
    out = out.withColumn("challenge_type", F.when(F.col("outcome") == "http_error", challenge_type(F.col("body"))))
    return out.withColumns({"body": F.when(shown, F.col("body")), "render_mode": F.lit(render_mode)}).drop("body_bytes")


def fetch_allowed(tasks: DataFrame, responses: DataFrame, policies: DataFrame) -> DataFrame:
    """As fetch(), for tasks (host, url) that their host's policy allows; the others are not fetched: robots_denied."""
    allowed, denied = split_allowed(tasks, policies)
    return fetch(allowed, responses).unionByName(denied, allowMissingColumns=True)


def split_allowed(tasks: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks that their host's policy allows, the others with their outcome)."""
    checked = robots_allowed(tasks, policies)
    denied = checked.filter("not allowed").withColumns({"outcome": F.lit("robots_denied"), "error_class": F.lit("robots_denied")})
    return checked.filter("allowed").drop("allowed"), denied.drop("allowed")


def fetch_with_render(tasks: DataFrame, static: DataFrame, rendered: DataFrame, slots: int | None = None, mode_col: str | None = None) -> DataFrame:
    """As fetch(); pages of domains that need a browser, and static pages that lack their content, take the rendered answer
    if it has a body. `js_evidence` tells whose static page was thin. Only pages that came whole are rendered again.

    mode_col: where it is true, the rendered answer is taken whatever it is; where it is false, the static one.
    `slots` bounds the tasks that read rendered answers at a time.
    """
    js = F.coalesce(F.col("js_required"), F.lit(False)) if "js_required" in tasks.columns else F.lit(False)
    mode = F.col(mode_col) if mode_col else F.lit(None).cast("boolean")
    first = fetch(tasks, static)
    thin = has_body(F.col("outcome"), F.octet_length("body")) & needs_render(F.col("body"))
    first = first.withColumn("_thin", F.coalesce(thin, F.lit(False))).withColumn("_want", js | F.col("_thin"))
    taken = ["status_code", "content_type", "body", "outcome", "render_mode", "duration_ms", "error_class", "error_detail", "challenge_type"]
    second = fetch(tasks.select("url").distinct(), rendered, "rendered")
    second = second.coalesce(slots) if slots else second
    second = second.select("url", has_body(F.col("outcome"), F.octet_length("body")).alias("_whole"), F.struct(*taken).alias("_r"))
    out = first.join(second, "url", "left")
    auto = mode.isNull() & F.col("_want") & F.col("_whole")
    use = F.coalesce(mode | auto, auto)
    evidence = mode.isNull() & F.col("_thin") & F.col("_whole")
    return out.withColumn("js_evidence", evidence).withColumns({c: F.when(use, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in taken}).drop("_thin", "_want", "_whole", "_r")


def resolve_challenges(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Challenged results with `resolution`: resolved where a recorded answer to the url (url, body) has no marker left.
    Such a result is ok and has that body; one that stays unresolved is what it was."""
    a = answers.select("url", F.col("body").alias("_body"))
    out = results.join(a, "url", "left")
    fine = F.col("challenge_type").isNotNull() & F.col("_body").isNotNull() & challenge_type(F.col("_body")).isNull()
    out = out.withColumn("resolution", F.when(F.col("challenge_type").isNull(), None).when(fine, "resolved").otherwise("unresolved"))
    done = F.coalesce(F.col("resolution") == "resolved", F.lit(False))
    put = {"body": F.col("_body"), "outcome": F.lit("ok"), "status_code": F.lit(200)}
    return out.withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in put.items() if c in results.columns}).drop("_body")


def robots_of(hosts: DataFrame, answers: DataFrame) -> DataFrame:
    """host, body, status of hosts (host, and their origin where known), from recorded answers by host, or by origin: a
    host without an origin is asked by https, and where that gives no answer at all, by http. None: null status."""
    if "host" in answers.columns:
        return hosts.select("host").join(answers.select("host", "body", "status"), "host", "left")
    each = answers.select(F.col("origin"), F.struct("body", "status").alias("a"))
    known = F.col("origin") if "origin" in hosts.columns else F.lit(None).cast("string")
    asked = hosts.select("host", known.alias("known"), F.explode(F.when(known.isNotNull(), F.array(known)).otherwise(F.array(*[F.concat(F.lit(s), F.col("host")) for s in ("https://", "http://")]))).alias("origin"))
    found = asked.join(each, "origin", "left").groupBy("host").agg(F.max_by("a", F.struct(F.col("a.status").isNotNull(), F.col("origin"))).alias("a"))
    return found.select("host", "a.*")


def robots(answers: DataFrame) -> DataFrame:
    """host, body, status as policies; an answer without a status counts as unavailable."""
    return parse_robots(answers.select("host", "body", "status"))


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(urls)), T.StructType([T.StructField("place", T.LongType()), T.StructField("url", T.StringType())]))


def spec_file(path: str) -> dict:
    return validate(json.loads(Path(path).read_text()))
