import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import urls as U

CASES = [
    ("HTTP://Example.COM:80/A//b/", None, "http://example.com/A/b"),
    ("https://www.example.com", None, "https://example.com/"),
    ("https://example.com:8443/x", None, "https://example.com:8443/x"),
    ("https://example.com/a/index.html", None, "https://example.com/a"),
    ("https://example.com/?b=2&a=1&utm_source=z&ref=q", None, "https://example.com/?a=1&b=2"),
    ("https://example.com/p?x=#frag", None, "https://example.com/p?x="),
    ("/next?id=3", "https://example.com/a/b", "https://example.com/next?id=3"),
    ("../up", "https://example.com/a/b/c", "https://example.com/a/up"),
    ("https://u:p@example.com/%7Ebob", None, "https://example.com/~bob"),
    ("mailto:a@b.c", None, None),
    ("  ", None, None),
    ("https://example.com:bad/", None, None),
]


@pytest.mark.parametrize(("raw", "base", "want"), CASES)
def test_canonical(raw, base, want):
    assert U.canonical(raw, base) == want


def test_normalize_column_agrees(spark):
    raw = [c[0] for c in CASES if c[1] is None] + [None, "http://a.b/ü?q=a+b", "https://x.y/?", "https://x.y/a?b&c=", "HTTPS://WWW.X.Y/default.aspx?spm=1"]
    rows = spark.createDataFrame([(r,) for r in raw], "u string").select("u", U.normalize(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in rows} == {r: U.canonical(r) for r in raw}


def test_plain_path_agrees_with_the_general_one(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.from_regex(r"\Ahttps?://(www\.)?[a-zA-Z0-9-]{1,6}(\.[a-z]{1,3}){1,2}(/[a-zA-Z0-9._~-]{1,8}){0,3}/?(\?[a-z]{1,3}=[a-z0-9]{0,2}(&[a-z_]{1,4}=[0-9]{0,2}){0,3})?(#x)?\Z"), min_size=30, max_size=60))
    def check(raw):
        df = spark.createDataFrame([(r,) for r in raw], "u string").filter(U.is_plain(F.col("u")))
        for r in df.select("u", U.canonical_plain(F.col("u")).alias("n")).collect():
            assert r.n == U.canonical(r.u), r.u

    check()


def test_hosts_and_origins(spark):
    rows = spark.createDataFrame([("https://www.A.com:8080/x",), ("http://b.com:80/",), ("ftp://c.com/",), ("nothing",)], "u string")
    got = rows.select(U.registrable_host(F.col("u")).alias("h"), U.robots_origin(F.col("u")).alias("o")).collect()
    assert [tuple(r) for r in got] == [("a.com", "https://www.a.com:8080"), ("b.com", "http://b.com"), ("c.com", None), (None, None)]


def test_normalize_runs_once(spark):
    """A filter on what normalize() gives takes no second pass of Python."""
    from spindrift.operators import frontier

    urls = frontier.new_urls(spark.createDataFrame([("http://e.com/a b", 1), ("mailto:x", 2), (None, 3)], "url string, place long"), place_col="place")
    assert urls._jdf.queryExecution().executedPlan().toString().count("+- ArrowEvalPython") == 1
    assert [r.url for r in urls.collect()] == ["http://e.com/a b"]
