from pyspark.sql import functions as F

from spindrift.functions import fetching, policy
from spindrift.sources import replay


def test_read_robots():
    r = policy.read_robots
    assert r("h", None, 403) == (False, 1000, True, False)
    assert r("h", "x", 503) == (False, 1000, False, False)
    assert r("h", None, 404) == (True, 1000, True, True)
    assert r("h", "", 200) == (True, 1000, True, True)
    assert r("h", "User-agent: *\nDisallow: /private\nCrawl-delay: 5", 200) == (True, 5000, True, True)
    assert r("h", "User-agent: *\nCrawl-delay: 999999", 200)[1] == 30_000
    assert r("h", "User-agent: *\nRequest-rate: 1/20", 200)[1] == 20_000
    assert r("h", "User-agent: *\nDisallow: /", 200)[0] is False


def test_unknown_host_is_closed(spark):
    urls = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/private/y"), ("b", "https://b/x")], "host string, url string")
    answers = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private", 200)], "host string, body string, status int")
    got = policy.robots_allowed(urls, replay.robots(answers)).collect()
    assert {r.url: r.allowed for r in got} == {"https://a/x": True, "https://a/private/y": False, "https://b/x": False}


def test_rules_are_those_of_the_parser(spark):
    import random
    from urllib.robotparser import RobotFileParser

    from spindrift.schemas import USER_AGENT

    rng = random.Random(3)
    parts = ["/", "/a", "/a/b", "/private", "/x?y=1", "/%7Euser", "/é", "/*", "", "/a;p", "//a"]
    bodies = ["\n".join([f"User-agent: {rng.choice(['*', 'MyCrawler', 'other'])}", *[f"{rng.choice(['Disallow', 'Allow'])}: {rng.choice(parts)}" for _ in range(rng.randint(0, 5))], "", f"User-agent: {rng.choice(['*', 'other'])}", f"Disallow: {rng.choice(parts)}"]) for _ in range(40)]
    rows = [(f"h{k}", f"https://h{k}{p}{q}") for k in range(40) for p in [*parts, "/a//b/", "/private/x.html"] for q in ("", "z", "?a=%2F#f")]
    answers = spark.createDataFrame([(f"h{k}", b, 200) for k, b in enumerate(bodies)], "host string, body string, status int")
    policies = replay.robots(answers).withColumn("is_crawlable", F.lit(True))
    got = policy.robots_allowed(spark.createDataFrame(rows, "host string, url string"), policies).collect()
    assert len(got) == len(rows)
    for r in got:
        parser = RobotFileParser()
        parser.parse(bodies[int(r.host[1:])].splitlines())
        assert r.allowed == parser.can_fetch(USER_AGENT, r.url), (bodies[int(r.host[1:])], r.url)


def test_unchanged_pages_and_charsets(spark):
    tasks = spark.createDataFrame([("u1", None, "Wed, 21 Oct 2015 07:28:00 GMT"), ("u2", None, "Wed, 21 Oct 2015 07:28:00 GMT"), ("u3", "old", "Wed, 21 Oct 2015 07:28:00 GMT"), ("u4", None, None), ("u5", None, None)], "url string, etag string, last_modified string")
    kind = "text/html; charset=ISO-8859-1"
    answers = [("u1", 200, kind, "e", "Wed, 21 Oct 2015 07:28:00 GMT", b"x", None, 1), ("u2", 200, kind, "e", "Thu, 22 Oct 2015 07:28:00 GMT", "é".encode("latin-1"), None, 1), ("u3", 200, kind, "new", "Wed, 21 Oct 2015 07:28:00 GMT", b"x", None, 1), ("u4", 200, "text/html; charset=none-such", None, None, "é".encode(), None, 1), ("u5", 200, "text/html", None, None, b"\xff", None, 1)]
    got = {r.url: r for r in replay.fetch(tasks, spark.createDataFrame([(*a[:5], bytearray(a[5]), *a[6:]) for a in answers], replay.RESPONSES.replace("body string", "body binary"))).collect()}
    assert [got[f"u{i}"].outcome for i in range(1, 6)] == ["not_modified", "ok", "ok", "ok", "ok"]
    assert (got["u1"].body, got["u2"].body, got["u4"].body, got["u5"].body) == (None, "é", "é", "\ufffd")


def test_challenges_come_in_order(spark):
    bodies = ["<p>reCAPTCHA</p>", "a captcha", "Just a moment... Cloudflare", "Access Denied", "fine", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(fetching.challenge_type(F.col("b")).alias("c")).collect()
    assert [r.c for r in rows] == ["recaptcha", "captcha", "cloudflare", "access_denied", None, None]


def test_needs_render(spark):
    many = " ".join(["word"] * 100)
    bodies = ['<div id="root"> </div>' + many, f"<p>{many}</p>", "<p>few</p>", f"<script>{many}</script>"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(fetching.needs_render(F.col("b")).alias("n")).collect()
    assert [r.n for r in rows] == [True, False, True, True]


def test_fetch_and_render(spark):
    tasks = spark.createDataFrame([("u1", "v1", False), ("u2", None, False), ("u3", None, True), ("u4", None, False)], "url string, etag string, js_required boolean")
    many = " ".join(["word"] * 100)
    static = spark.createDataFrame([("u1", 200, "text/html", "v1", None, "x", None, 1), ("u2", 200, "text/html", None, None, "thin", None, 1), ("u3", 200, "text/html", None, None, many, None, 1), ("u4", 403, "text/html", None, None, "Access Denied", None, 1)], replay.RESPONSES)
    rendered = spark.createDataFrame([(u, 200, "text/html", None, None, f"rendered {many}", None, 9) for u in ("u2", "u3", "u4")], replay.RESPONSES)
    got = {r.url: r for r in replay.fetch_with_render(tasks, static, rendered).collect()}
    assert got["u1"].outcome == "not_modified" and got["u1"].body is None
    assert got["u2"].render_mode == "rendered" and got["u2"].js_evidence
    assert got["u3"].render_mode == "rendered" and not got["u3"].js_evidence
    assert got["u4"].outcome == "http_error" and got["u4"].challenge_type == "access_denied"


def test_outcome_order(spark):
    rows = [(304, "text/html", 1, None), (404, "text/html", 6_000_000, None), (404, None, 1, None), (200, "application/pdf", 1, None), (200, "text/html", 6_000_000, None), (200, "text/html", 1, None), (None, None, None, "X")]
    df = spark.createDataFrame(rows, "s int, t string, n long, e string")
    got = df.select(fetching.outcome(F.col("s"), F.col("t"), F.col("n"), F.col("e")).alias("o")).collect()
    assert [r.o for r in got] == ["not_modified", "too_large", "http_error", "non_html", "too_large", "ok", "network_error"]


def test_refresh(spark):
    from datetime import datetime

    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = [("new", None, None, None, None, 1000, True), ("fresh", "x", 200, datetime(2026, 1, 1, 12), None, 1000, True), ("old", "x", 200, datetime(2025, 12, 31), None, 1000, True)]
    domains = spark.createDataFrame(rows, "host string, robots_body string, robots_status short, robots_fetched_at timestamp, robots_expires_at timestamp, crawl_delay_ms int, is_crawlable boolean")
    assert sorted(r.host for r in policy.hosts_to_refresh(domains, now).collect()) == ["new", "old"]
    answers = spark.createDataFrame([("new", "User-agent: *\nCrawl-delay: 3", 200), ("old", None, None)], "host string, body string, status int")
    got = {r.host: r for r in policy.refresh(domains, answers, now).collect()}
    assert (got["new"].crawl_delay_ms, got["new"].robots_fetched_at) == (3000, datetime(2026, 1, 2))
    assert (got["old"].is_crawlable, got["old"].robots_fetched_at) == (False, None) and got["fresh"].robots_fetched_at == datetime(2026, 1, 1, 12)
