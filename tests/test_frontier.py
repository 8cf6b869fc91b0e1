from datetime import datetime

from pyspark.sql import functions as F

from spindrift.operators import frontier, neardup, specs

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")

PAST, FUTURE = datetime(2025, 12, 31), datetime(2026, 1, 2)
URLS = "url_id long, domain_id long, url string, priority int, status string, next_crawl_at timestamp, attempt_count int, consecutive_failures int, lease_owner string, lease_expires_at timestamp"
DOMAINS = "domain_id long, host string, is_crawlable boolean, next_available_at timestamp, crawl_delay_ms int, js_required boolean, js_evidence_count int"


def urls(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0, None, None) for r in rows], URLS)


def domains(spark):
    return spark.createDataFrame([(1, "a", True, PAST, 1000, False, 2), (2, "b", False, PAST, 1000, False, 0), (3, "c", True, FUTURE, 1000, False, 0), (4, "d", True, PAST, 2500, False, 0)], DOMAINS)


def test_claim_takes_the_best_of_each_domain(spark):
    u = urls(spark, (1, 1, "a/low", 10, "pending", PAST), (2, 1, "a/high", 999, "pending", PAST), (3, 2, "b", 1, "pending", PAST), (4, 3, "c", 1, "pending", PAST), (5, 4, "d", 1, "pending", FUTURE), (6, 4, "d2", 1, "leased", PAST))
    assert [r.url_id for r in frontier.claim(u, domains(spark), now()).collect()] == [2]
    assert sorted(r.url_id for r in frontier.claim(u, domains(spark), now(), strict=False).collect()) == [2, 3, 4]
    assert [r.url_id for r in frontier.claim(u, domains(spark), now(), batch=1, strict=False).collect()] == [2]


def test_lease_reap_renew(spark):
    u = urls(spark, (1, 1, "a", 1, "pending", PAST), (2, 1, "b", 1, "pending", PAST))
    leased = frontier.lease(u, u.filter("url_id = 1"), "w", now())
    r = {x.url_id: x for x in leased.collect()}
    assert (r[1].status, r[1].lease_owner, r[1].attempt_count, r[2].status) == ("leased", "w", 1, "pending")
    later = F.lit("2026-01-01 00:05:01").cast("timestamp")
    assert frontier.reap(leased, now()).filter("reaped").count() == 0
    back = {x.url_id: x for x in frontier.reap(leased, later).collect()}
    assert back[1].reaped and back[1].status == "pending" and back[1].lease_owner is None
    assert frontier.renew(leased, F.lit("other"), now()).filter("renewed").count() == 0
    assert frontier.renew(leased, F.lit("w"), now()).filter("renewed").count() == 1


def test_five_failures(spark):
    u = urls(spark, (1, 1, "a", 1, "leased", PAST))
    waits = []
    for k in range(5):
        u = frontier.fail(u, now())
        r = u.first()
        waits.append((r.next_crawl_at - datetime(2026, 1, 1)).total_seconds() / 60)
        assert r.status == ("failed" if k == 4 else "pending")
    assert waits == [1, 2, 4, 8, 16]


def test_links_and_edges(spark):
    links = spark.createDataFrame([(1, "http://x/a", 0, 0, "first", None), (1, "http://x/a", 1, 0, "second", None), (1, "http://x/b", 2, 6, None, None)], "from_url_id long, url string, place long, depth int, anchor_text string, rel string")
    known = spark.createDataFrame([], "url_key string")
    new = frontier.add_links(links, known, now()).collect()
    assert [(r.url, r.depth, r.priority) for r in new] == [("http://x/a", 1, 100)]
    edges = frontier.add_edges(links, spark.createDataFrame([("http://x/a", 7)], "url string, url_id long")).collect()
    assert [tuple(r) for r in edges] == [(1, 7, "first", None)]


def test_advance_and_evidence(spark):
    d = domains(spark)
    after = {r.domain_id: r for r in frontier.advance_domains(d, d.filter("domain_id = 4"), now()).collect()}
    assert after[4].next_available_at == datetime(2026, 1, 1, 0, 0, 2, 500_000) and after[1].next_available_at == PAST
    seen = {r.host: r for r in frontier.js_evidence(d, spark.createDataFrame([("a",), ("d",)], "host string")).collect()}
    assert seen["a"].js_required and seen["a"].js_evidence_count == 3 and not seen["d"].js_required


def test_near_duplicates(spark):
    base = 0x1234567890ABCDEF
    rows = [(1, base), (2, base ^ 0b111), (3, base ^ 0b1111 << 20), (4, base), (5, None), (6, base ^ (1 << 62))]
    df = spark.createDataFrame(rows, "id long, simhash long")
    assert {r.id: r.duplicate_of for r in neardup.any_duplicates(df, "id").collect()} == {1: 2, 2: 1, 4: 1, 6: 1}
    assert {r.id: r.duplicate_of for r in neardup.any_duplicates(df, "id", banded=False).collect()} == {1: 2, 2: 1, 4: 1}
    assert {r.id: r.duplicate_of for r in neardup.first_duplicates(df, "id").collect()} == {2: 1, 4: 1, 6: 1}
    done = spark.createDataFrame([(99, base)], "id long, simhash long")
    assert {r.id: r.duplicate_of for r in neardup.first_duplicates(df, "id", indexed=done).collect()}[1] == 99


def test_specs(spark):
    import pytest

    with pytest.raises(ValueError):
        specs.validate({"name": "x", "fields": [], "render_mode": "sometimes"})
    with pytest.raises(ValueError):
        specs.validate({"name": "x", "fields": [{"name": "a", "selector": "b", "selector_type": "regex"}]})
    assert specs.validate({"name": "x", "fields": []})["version"] == 1


def test_crawl_round_takes_every_due_domain(spark, monkeypatch):
    from spindrift.plans import catalogue

    n = 10_050  # one page a host, of which the last ones have words
    made = spark.range(n).select((F.col("id") * 5 * 7 * 12 + 10).alias("page_id"), F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".example/")).alias("url"), F.when(F.col("id") >= n - 3, F.concat(F.lit("<main>only words of page "), F.col("id").cast("string"), F.lit("</main>"))).otherwise("").alias("html"))
    monkeypatch.setattr(catalogue.T, "pages", lambda spark, d: made)
    assert {r.url for r in catalogue.crawl_round(spark, "").collect()} <= {f"https://h{i}.example/" for i in range(n - 3, n)}
    assert catalogue.crawl_round(spark, "").count() >= 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_enroll_has_no_cross_join(spark):
    rows = [(i, f"https://h{i % 3}/p{i}", f"k{i}", f"h{i % 3}") for i in range(30)]
    u = spark.createDataFrame(rows, "domain_id long, url string, url_key string, host string")
    s = [(k, None if k % 2 else f"h{k % 3}", None if k % 5 == 0 else f"p{k}") for k in range(12)]
    sp = spark.createDataFrame([(*x, True, True) for x in s], "spec_id long, host_pattern string, path_regex string, feed_from_crawler boolean, is_active boolean")
    want = {(k, url) for k, h, p in s for _, url, _, host in rows if (h is None or h == host) and (p is None or p in url)}
    for block in (200, 2):
        got = frontier.enroll(u, sp, block=block)
        assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
        found = [(r.spec_id, r.url) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want


def test_expand_reads_layers_once(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(5, 0), (0, 2)], "from_id long, to_id long")
    got = frontier.expand(spark.createDataFrame([(0,), (0,)], "url_id long"), edges)
    assert {r.url_id: r.depth for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}
    assert plan(got).count("FileScan parquet") <= 8 and got.count() == 8


def test_claim_orders_by_three_columns_alone(spark):
    u = urls(spark, *[(i, i % 3, f"u{i}", i % 2, "pending", PAST) for i in range(30)])
    d = spark.createDataFrame([(k, f"h{k}", True, PAST, 1000, False, 0) for k in range(3)], DOMAINS)
    got = frontier.claim(u, d, now())
    assert sorted((r.domain_id, r.url_id, r.url) for r in got.collect()) == [(0, 3, "u3"), (1, 1, "u1"), (2, 5, "u5")]
    for line in plan(got).splitlines():
        assert not ("SortAggregate" in line and "url#" in line)


def test_ids_have_no_gaps(spark):
    rows = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "place long").repartition(7)
    got = frontier.dense_ids(rows, ["place"], 11, "id").collect()
    assert sorted((r.place, r.id) for r in got) == [(i, i + 11) for i in range(1000)]
    assert frontier.dense_ids(rows.limit(0), ["place"], 1, "id").collect() == []


def test_minima_of_dense_fingerprints(spark, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(2)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
    rows = []
    for i in range(300):
        s = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            s ^= -1 << 63 if rng.random() < 0.1 else 1 << rng.randrange(63)
        rows.append((i * 7 % 300, s))
    df = spark.createDataFrame(rows, "id long, simhash long")
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 3
    want = {i: min((j for j, t in rows if j != i and near(s, t)), default=None) for i, s in rows}
    assert {r.id: r.duplicate_of for r in neardup.any_duplicates(df, "id").collect()} == {i: j for i, j in want.items() if j is not None}
    first = {i: min((j for j, t in rows if j < i and near(s, t)), default=None) for i, s in rows}
    assert {r.id: r.duplicate_of for r in neardup.first_duplicates(df, "id").collect()} == {i: j for i, j in first.items() if j is not None}
    top = {i: min((j for j, t in rows if j != i and near(s, t) and s >> 56 == t >> 56), default=None) for i, s in rows}
    assert {r.id: r.duplicate_of for r in neardup.any_duplicates(df, "id", banded=False).collect()} == {i: j for i, j in top.items() if j is not None}


def test_close_fingerprints(spark, monkeypatch):
    """Each close pair once, compared in blocks; no keys are sent to the driver, however small their table is held to be."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    s = [rng.getrandbits(64) for _ in range(20)]
    s += [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in s for k in range(5)]
    s += [s[0] ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)]
    s = sorted({x - (1 << 64) if x >> 63 else x for x in s})
    want = {(a, b) for i, a in enumerate(s) for b in s[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    pairs = neardup.close_fingerprints(spark.createDataFrame([(x,) for x in [*s, s[0], None]], "simhash long"))
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    top = neardup.close_fingerprints(spark.createDataFrame([(x,) for x in s], "simhash long"), banded=False)
    assert sorted(map(tuple, top.collect())) == sorted((a, b) for a, b in want if a >> 56 == b >> 56)
    written = neardup.cut(spark.createDataFrame([(x, x) for x in s], "simhash long, l long"), "least")
    assert "Broadcast" not in neardup.close_minima(written, ["l"])._jdf.queryExecution().executedPlan().toString()
