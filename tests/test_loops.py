import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindrift import __main__ as cli
from spindrift.operators import attempts
from spindrift.sources import replay
from spindrift.sources.store import SnapshotStore, compress, decompress
from spindrift.streaming.loops import Crawl, stream_attempts, watch_seeds

T0, T1 = "2026-01-01 00:00:00", "2026-01-01 01:00:00"
TEXT = " ".join(f"word{i}" for i in range(90))
PAGES = [("https://a.example/", f"<html><body><main>{TEXT} start <a href='/one'>1</a><a href='https://b.example/'>b</a></main>"), ("https://a.example/one", f"<html><body><main>{TEXT} start 1 b</main>"), ("https://b.example/", '<meta name="robots" content="noindex"><body>x')]


def pages(spark, rows):
    return replay.from_pages(spark.createDataFrame(rows, "url string, html string"))


def by_url(df):
    return {r.url: r for r in df.collect()}


def test_store_changes_tables_at_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), buckets=4)
    t = lambda rows: spark.createDataFrame(rows, "k long, v string")
    schema = t([]).schema
    assert store.read("a", schema).count() == 0
    store.commit({"a": (t([(i, "x") for i in range(40)]), ["k"]), "b": (t([(1, "b")]), None)})
    before = store._manifest()["a"]
    store.commit({"a": (t([(3, "y"), (100, "z")]), ["k"]), "b": (t([(2, "c")]), None)})
    rows = {r.k: r.v for r in store.read("a", schema).collect()}
    assert rows == {i: "x" for i in range(40)} | {3: "y", 100: "z"} and [r.k for r in store.read("b", schema).collect()] == [2]
    assert 1 <= sum(before[b] != f for b, f in store._manifest()["a"].items()) <= 2  # other buckets stay as they were
    assert store.write("a", t([]), ["k"]) == 3 and store.read("a", schema).count() == 41
    store.vacuum(1)
    assert store.versions() == [3] and store.read("a", schema).count() == 41
    with pytest.raises(RuntimeError):
        (tmp_path / "_manifest" / "4").write_text("{}")
        store.versions = lambda: [3]
        store.write("a", t([(1, "w")]), None)


def test_crawl_follows_a_chain_to_its_depth(spark, tmp_path):
    chain = [(f"https://h{i}.example/", f"<body><main>{TEXT} page {' '.join(f'p{i}x{j}' for j in range(60))} <a href='https://h{i + 1}.example/'>next</a> <a href='https://h{i}.example/'>self</a></main>") for i in range(9)]
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "s"), 4), pages(spark, chain), str(tmp_path / "history"))
    crawl.seed(replay.seeds(spark, ["https://h0.example/"]), T0)
    for _ in range(7):
        assert crawl.round(T0, batch=None) == 1
    assert crawl.round(T0) == 0
    urls = sorted(crawl.read("urls").collect(), key=lambda r: r.depth)
    assert [(r.url, r.depth, r.url_id, r.status) for r in urls] == [(f"https://h{i}.example/", i, i + 1, "done") for i in range(7)]
    assert all(r.domain_id == r.url_id and r.render_mode == "static" and r.last_status_code == 200 and r.content_sha256 for r in urls)
    assert crawl.read("links").count() == 12 and crawl.read("documents").count() == 7  # nothing is followed from the last depth
    assert {r.host: (r.pages_crawled, r.pages_discovered, r.error_count) for r in crawl.read("domains").collect()}["h3.example"] == (1, 2, 0)
    blobs = {r.key: r.payload for r in decompress(crawl.read("blobs")).collect()}
    doc = by_url(crawl.read("documents"))["https://h2.example/"]
    assert blobs[doc.raw_key] == chain[2][1] and blobs[doc.text_key] == doc.text and len(blobs) == 14
    assert spark.read.parquet(str(tmp_path / "history")).count() == 7


def test_crawl_rounds(spark, tmp_path):
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "store"), 2), pages(spark, PAGES), str(tmp_path / "history"))
    seeds = tmp_path / "seeds"
    seeds.mkdir()
    (seeds / "one.txt").write_text("https://www.a.example/\nhttps://a.example/missing\n\nmailto:x@y\n")
    watch_seeds(crawl, str(seeds), str(tmp_path / "ck"), T0).awaitTermination()
    assert crawl.read("urls").count() == 2
    assert crawl.round(T0) == 1
    assert crawl.round(T0) == 1  # b.example alone: a.example is not available again yet
    assert crawl.round(T1) == 1
    state = by_url(crawl.read("urls"))
    assert state["https://a.example/"].status == "done" and state["https://b.example/"].status == "skipped"
    assert (state["https://a.example/missing"].status, state["https://a.example/missing"].consecutive_failures) == ("pending", 1)
    errors = {r.host: r.error_count for r in crawl.read("domains").collect()}
    assert errors == {"a.example": 1, "b.example": 0}
    told = spark.read.parquet(str(tmp_path / "history")).collect()
    assert len(told) == 3 and {r.error_detail for r in told} == {None, "no recorded answer"}

    def broken(rows):
        raise OSError("no index")

    with pytest.raises(OSError):
        crawl.index_all(T1, broken)
    assert [r.index_state for r in crawl.read("documents").collect()] == ["failed"]
    got = []
    assert crawl.index_all(T1, got.append) == 0
    crawl.retry_failed()
    assert crawl.index_all(T1, lambda rows: got.extend(rows.collect())) == 1 and got[0].url == "https://a.example/"
    assert [r.index_state for r in crawl.read("documents").collect()] == ["indexed"]


def test_thin_pages_are_rendered_and_domains_learn_it(spark, tmp_path):
    thin = [(f"https://a.example/{i}", "<body><div id='root'></div>") for i in range(3)]
    full = [(u, f"<body><main>{TEXT} rendered {u}</main>") for u, _ in thin]
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "s"), 2), pages(spark, thin), None, rendered=pages(spark, full), slots=2)
    crawl.seed(replay.seeds(spark, [u for u, _ in thin]), T0)
    for k in range(3):
        assert crawl.round(f"2026-01-01 0{k}:00:00") == 1
        (domain,) = crawl.read("domains").collect()
        assert (domain.js_evidence_count, domain.js_required, domain.pages_crawled) == (k + 1, k >= 2, k + 1)
    assert {r.render_mode for r in crawl.read("urls").collect()} == {"rendered"}
    assert all("rendered" in r.text for r in crawl.read("documents").collect())


def test_challenges_are_resolved_or_fail(spark, tmp_path):
    rows = [(f"https://{h}.example/", 403, "text/html", None, None, "Access Denied", None, 1) for h in "ab"]
    solved = spark.createDataFrame([("https://a.example/", PAGES[1][1])], "url string, body string")
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "s"), 2), spark.createDataFrame(rows, replay.RESPONSES), None, resolutions=solved)
    crawl.seed(replay.seeds(spark, [r[0] for r in rows]), T0)
    assert crawl.round(T0) == 2
    state = by_url(crawl.read("urls"))
    assert (state["https://a.example/"].status, state["https://b.example/"].status) == ("done", "pending")
    assert state["https://b.example/"].last_status_code == 403 and state["https://b.example/"].consecutive_failures == 1


def test_feeds_both_ways(spark, tmp_path):
    spec = {"name": "t", "fields": [{"name": "links", "selector": "a", "attr": "href", "many": True}], "link_field": "links", "feed_to_crawler": True, "feed_from_crawler": True, "host_pattern": "a.example"}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    spark.createDataFrame(PAGES, "url string, html string").write.parquet(str(tmp_path / "pages"))
    run = lambda *a: cli.main(["--store", str(tmp_path / "s"), "--answers", str(tmp_path / "pages"), "--now", T0, *a], spark)
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "s")), None)
    run("spec", "add", str(tmp_path / "spec.json"))
    run("seed", "https://a.example/")
    run("crawl", "--feed-scraper")
    (target,) = crawl.read("targets").collect()
    assert (target.url, target.status, target.spec_id) == ("https://a.example/", "pending", 1)
    cli.main(["--store", str(tmp_path / "s"), "--answers", str(tmp_path / "pages"), "--now", T1, "scrape", "--batch", "0"], spark)
    (target,) = crawl.read("targets").collect()
    assert target.status == "done" and crawl.read("records").count() == 1
    urls = by_url(crawl.read("urls"))
    assert set(urls) == {"https://a.example/", "https://a.example/one", "https://b.example/"} and len({r.url_id for r in urls.values()}) == 3
    run("submit-scrape", "t", "https://c.example/new")
    c = {r.host: r for r in crawl.read("domains").collect()}["c.example"]
    assert c.domain_id < 0 and {r.domain_id for r in crawl.read("targets").collect()} == {target.domain_id, c.domain_id}
    run("seed", "https://c.example/new")
    assert by_url(crawl.read("urls"))["https://c.example/new"].domain_id == c.domain_id


def test_scrape_by_render_mode(spark, tmp_path):
    hosts = ["auto", "always", "never", "gone", "noindex", "fails"]
    static = [(f"https://{h}.example/", "<main>thin</main>") for h in hosts[:3]] + [("https://noindex.example/", "")]
    full = [(f"https://{h}.example/", f"<main>{TEXT} rendered</main>") for h in hosts[:2]]
    store = SnapshotStore(spark, str(tmp_path / "s"), 2)
    modes = spark.createDataFrame([(i + 1, m, 1, '[{"name": "m", "selector": "main"}]', m, False, False, True) for i, m in enumerate(("auto", "always", "never"))], "spec_id long, name string, version int, fields string, render_mode string, feed_to_crawler boolean, feed_from_crawler boolean, is_active boolean")

    def work(rendered):
        crawl = Crawl(spark, store, pages(spark, static), None, rendered=rendered)
        crawl.put(specs=modes)
        return crawl

    crawl = work(None)
    for i, h in enumerate(["auto", "always", "never"]):
        crawl.submit(i + 1, replay.seeds(spark, [f"https://{h}.example/"]), T0)
    assert crawl.scrape_round(T0) == {"done": 2, "render_required_unavailable": 1}
    crawl = work(pages(spark, full))
    crawl.put(targets=crawl.read("targets").withColumns({"status": F.lit("pending"), "next_attempt_at": F.lit(T0).cast("timestamp")}))
    for h in ("noindex", "fails"):
        crawl.submit(3, replay.seeds(spark, [f"https://{h}.example/"]), T0)
    got = crawl.scrape_round(T1)
    assert got == {"done": 3, "no_content": 1, "failed": 1}
    said = {r.spec_id: json.loads(r.data)["m"] for r in crawl.read("records").collect()}
    assert said[1].endswith("rendered") and said[2].endswith("rendered") and said[3] == "thin"
    state = by_url(crawl.read("targets"))
    assert (state["https://noindex.example/"].status, state["https://fails.example/"].status) == ("skipped", "pending")
    assert crawl.read("blobs").count() == 3 and all(r.raw_key.startswith("scrape/") for r in crawl.read("records").collect())
    # A claim holds its domains back, and targets of a spec that is not active stay.
    assert crawl.scrape_round(T1) == {}
    crawl.put(specs=modes.withColumn("is_active", F.lit(False)), targets=crawl.read("targets").withColumns({"status": F.lit("pending"), "next_attempt_at": F.lit(T0).cast("timestamp")}))
    assert crawl.scrape_round("2026-02-01 00:00:00") == {}


def test_leases_are_reaped(spark, tmp_path, capsys):
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "s"), 2), None)
    crawl.seed(replay.seeds(spark, ["https://a.example/", "https://b.example/"]), T0)
    crawl.put(specs=spark.createDataFrame([(1, "t", True)], "spec_id long, name string, is_active boolean"))
    crawl.submit(1, replay.seeds(spark, ["https://a.example/t"]), T0)
    late = {"status": F.lit("leased"), "lease_owner": F.lit("w"), "lease_expires_at": F.lit(T0).cast("timestamp")}
    crawl.put(urls=crawl.read("urls").filter("host = 'a.example'").withColumns(late), targets=crawl.read("targets").withColumns(late))
    cli.main(["--store", str(tmp_path / "s"), "--now", T1, "reap"], spark)
    assert json.loads(capsys.readouterr().out) == {"reaped": {"urls": 1, "targets": 1}}
    assert {r.status for r in crawl.read("urls").collect()} == {r.status for r in crawl.read("targets").collect()} == {"pending"}


def test_cli_scrape(spark, tmp_path, capsys):
    spec = tmp_path / "spec.json"
    spec.write_text('{"name": "t", "fields": [{"name": "links", "selector": "a", "attr": "href", "many": true}], "link_field": "links"}')
    spark.createDataFrame(PAGES, "url string, html string").write.parquet(str(tmp_path / "pages"))
    run = lambda *a: cli.main(["--store", str(tmp_path / "s"), "--answers", str(tmp_path / "pages"), "--now", T0, *a], spark)
    run("spec", "add", str(spec))
    run("submit-scrape", "t", "https://a.example/", "https://a.example/gone")
    run("scrape")
    run("records", "list", "t")
    out = capsys.readouterr().out
    assert "https://a.example/one" in out
    run("spec", "deactivate", "t")
    run("spec", "list")
    assert '"is_active":false' in capsys.readouterr().out


def test_robots_rules_hold_where_urls_are_fetched(spark, tmp_path, capsys):
    rules = [("a.example", "User-agent: *\nDisallow: /one", 200), ("c.example", None, 403), ("d.example", None, 503)]
    robots = spark.createDataFrame(rules, "host string, body string, status int")
    urls = ["https://a.example/one", "https://b.example/", "https://c.example/", "https://d.example/"]
    answers = spark.createDataFrame([(u, PAGES[1][1]) for u in [*urls, "https://a.example/"]], "url string, html string")
    crawl = Crawl(spark, SnapshotStore(spark, str(tmp_path / "store"), 2), replay.from_pages(answers), None, robots)
    crawl.seed(replay.seeds(spark, urls), T0)
    assert crawl.round(T0) == 1 and crawl.round(T1) == 0
    state = {r.url: r.status for r in crawl.read("urls").collect()}
    assert [state[u] for u in urls] == ["skipped", "pending", "pending", "pending"] and crawl.read("documents").count() == 0
    crawl.robots = robots.filter("host <> 'd.example'").union(spark.createDataFrame([("d.example", None, 404)], robots.schema))
    assert crawl.round(T1) == 1 and [r.url for r in crawl.read("documents").collect()] == ["https://d.example/"]

    spec = tmp_path / "spec.json"
    spec.write_text('{"name": "t", "fields": [{"name": "m", "selector": "main"}]}')
    answers.write.parquet(str(tmp_path / "pages"))
    robots.write.parquet(str(tmp_path / "robots"))
    run = lambda now, *a: cli.main(["--store", str(tmp_path / "s"), "--answers", str(tmp_path / "pages"), "--robots", str(tmp_path / "robots"), "--now", now, *a], spark)
    run(T0, "spec", "add", str(spec))
    run(T0, "submit-scrape", "t", *urls, "https://a.example/")
    run(T0, "scrape")
    run(T1, "scrape")
    targets = {r.url: r.status for r in Crawl(spark, SnapshotStore(spark, str(tmp_path / "s")), None).read("targets").collect()}
    # Hosts that are closed or unknown are not claimed; what the rules deny is skipped.
    assert targets == dict.fromkeys(urls[1:], "pending") | {urls[0]: "skipped", "https://a.example/": "done"}


def test_robots_answers_by_origin(spark):
    hosts = spark.createDataFrame([("a", "http://a:8080"), ("b", None), ("c", None), ("d", "https://d")], "host string, origin string")
    answers = spark.createDataFrame([("http://a:8080", "A", 200), ("https://a", "no", 200), ("https://b", "B", 200), ("http://b", "no", 200), ("https://c", None, None), ("http://c", None, 404), ("http://d", "no", 200)], "origin string, body string, status int")
    assert {r.host: (r.body, r.status) for r in replay.robots_of(hosts, answers).collect()} == {"a": ("A", 200), "b": ("B", 200), "c": (None, 404), "d": (None, None)}


def test_attempts_stream_and_retention(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.sql("SELECT id, timestamp'2026-01-15 00:00:00' - make_dt_interval(cast(id * 20 as int)) AS started_at FROM range(8)").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    stream_attempts(stream, out, str(tmp_path / "ck")).awaitTermination()
    dropped = attempts.drop_old(spark, out, "2026-01-20 00:00:00")
    assert "started_month=2025-12-01" not in dropped and "started_month=2025-11-01" in dropped


def test_blobs(spark):
    rows = [("k", "payload é"), ("n", None)]
    back = decompress(compress(spark.createDataFrame(rows, "key string, payload string"))).collect()
    assert sorted((r.key, r.payload) for r in back) == rows


def test_windowed_outcomes(spark):
    from spindrift.streaming.loops import windowed_outcomes

    rows = [(datetime(2026, 1, 1, h, m), o) for h, m, o in ((0, 1, "ok"), (0, 59, "ok"), (1, 0, "ok"), (0, 5, "http_error"))]
    got = windowed_outcomes(spark.createDataFrame(rows, "started_at timestamp, outcome string")).collect()
    assert {(r.window.start.hour, r.outcome): r.n for r in got} == {(0, "ok"): 2, (1, "ok"): 1, (0, "http_error"): 1}
