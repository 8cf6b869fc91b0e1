import json

from spindrift.functions import html as dom
from spindrift.functions.fingerprints import simhash_of
from spindrift.operators import extract

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title> A <b>title</b></title><meta name="description" content="about">
<link rel="canonical" href="/canon?utm_source=x"></head><body><nav><a href="/n">N</a></nav><main><h1>Head</h1><p>one<p>two
<a href="/x#f" rel="nofollow">X</a><a href="/x">again</a><a href="mailto:q@r">m</a></main><footer>foot</footer></body></html>"""
SHELF = """<ul id="shelf"><li class="book old"><b>Tides</b><i> 1911 </i></li><li class="book"><b>Harbour lights</b><i>1954</i><a class="more" href="/lights">read</a></li></ul>"""


def test_page():
    p = extract.page_of(PAGE, "https://example.com/a/")
    assert (p["canonical_url"], p["description"], p["lang"]) == ("https://example.com/canon", "about", "en")
    assert p["text"] == "Head one two X again m"
    assert [(x["url"], x["anchor_text"], x["rel"]) for x in p["links"]] == [("https://example.com/n", "N", None), ("https://example.com/x", "X", "nofollow")]


def test_noindex_and_empty():
    assert extract.page_of('<meta name="robots" content="NOINDEX, follow"><body>x', "https://e.com") is None
    assert extract.page_of("", "https://e.com") is None
    assert extract.page_of(None, "https://e.com") is None


def test_record_nested():
    spec = [extract.Field.read(d) for d in [{"name": "books", "selector": "li.book", "many": True, "fields": [{"name": "title", "selector": "b"}, {"name": "year", "selector": ".//i/text()", "selector_type": "xpath"}]}, {"name": "gone", "selector": "#x"}, {"name": "more", "selector": "a.more", "attr": "href"}]]
    r = extract.scrape_record(SHELF, "https://e.com/l", spec, "more")
    assert json.loads(r["data"]) == {"books": [{"title": "Tides", "year": "1911"}, {"title": "Harbour lights", "year": "1954"}], "gone": None, "more": "https://e.com/lights"}
    assert r["links"] == ["https://e.com/lights"]


def test_parts_of_pages(spark):
    df = spark.createDataFrame([(1, "https://example.com/a/", PAGE), (2, "https://e.com/", '<meta name="robots" content="noindex">x'), (3, "https://e.com/", None)], "page_id long, url string, html string")
    whole = extract.extract_pages(df).collect()
    assert [r.page_id for r in whole] == [1] and (whole[0].word_count, whole[0].simhash) == (6, simhash_of(whole[0].text))
    links = extract.extract_pages(df, parts=("links",))
    assert links.columns == ["page_id", "url", "links"] and links.collect()[0].links == whole[0].links
    assert extract.extract_pages(df, parts=("title", "lang")).collect()[0].title == whole[0].title
    hidden = "<body><header><main>no</main></header><nav><title>n</title></nav><article>yes <script>s</script><footer>f</footer></article><title>t</title>"
    assert extract.page_of(hidden, "https://e.com", ("title", "text")) == {"title": "t", "text": "yes"}


def test_targets_of_several_specs(spark):
    rows = [(1, "https://e.com/l", SHELF, '[{"name": "t", "selector": "b"}]', None), (2, "https://e.com/l", SHELF, '[{"name": "m", "selector": "a", "attr": "href"}]', "m"), (3, "https://e.com/l", None, "[]", None), (4, "https://e.com/l", SHELF, None, None)]
    got = {r.id: (r.data, r.links) for r in extract.scrape_targets(spark.createDataFrame(rows, "id long, url string, html string, fields string, link_field string")).collect()}
    assert got == {1: ('{"t": "Tides"}', []), 2: ('{"m": "https://e.com/lights"}', ["https://e.com/lights"]), 3: (None, []), 4: (None, [])}


def test_selectors():
    t = dom.parse("<ul><li class='a b'>1<li>2<li data-x='y z'>3</ul><div><p>p1</p><span>s</span><p>p2</p></div>")
    text = lambda s: [n.text() for n in dom.css(t, s)]
    assert text("li") == ["1", "2", "3"] and text("li.b") == ["1"] and text("li[data-x~=z]") == ["3"]
    assert text("div > p") == ["p1", "p2"] and text("p + span") == ["s"] and text("p ~ p") == ["p2"] and text("li:nth-child(2), span") == ["2", "s"]
    assert dom.xpath(t, "//li[@data-x='y z']/text()") == ["3"] and [n.text() for n in dom.xpath(t, "//div/p[2]")] == ["p2"]
    assert dom.xpath(t, "//li[contains(@class,'b')]/@class") == ["a b"]


def test_open_references():
    """A record keeps a reference without a semicolon, an extracted page reads it as HTML does; scripts are as they were."""
    html = "<html><title>a&amp;&amp;&am; b&amp</title><script>x&amp&lt;y</script><a href='/q?a=1&copy=2&amp;b'>&#65 &nosuch; &lt</a>"
    fields = [extract.Field.read(f) for f in ({"name": "t", "selector": "title"}, {"name": "s", "selector": "script"}, {"name": "a", "selector": "a"}, {"name": "h", "selector": "a", "attr": "href"})]
    r = json.loads(extract.scrape_record(html, "https://e.com/", fields, None)["data"])
    assert r == {"t": "a&&&am; b&amp", "s": "x&amp&lt;y", "a": "A &nosuch; &lt", "h": "https://e.com/q?a=1&copy=2&b"}
    assert extract.page_of(html, "https://e.com/", ("title",))["title"] == "a&&&am; b&"
    assert dom.parse("<p>\ufdd0 &amp", closed=True).text() == "\ufdd0 &amp"


def test_simhash():
    assert simhash_of("") == 0 and simhash_of(None) is None
    assert simhash_of("a b") == simhash_of("ab") and simhash_of("The quick brown fox") == simhash_of("the QUICK brown fox")
    a = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf today " * 8
    assert ((simhash_of(a) ^ simhash_of(a + "end")) & (2**64 - 1)).bit_count() <= 6


def _passes(df):
    import re

    return re.findall(r"ArrowEvalPython|MapInArrow", df._jdf.queryExecution().executedPlan().toString())


def test_one_pass(spark):
    """Pages are parsed once, in one pass that makes raw urls canonical too, whatever filters and explodes follow."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "HTTPS://www.Example.com/a%20b/?utm_source=x", PAGE, [1]), (2, "https://e.com/", None, None), (3, "mailto:q", PAGE, [])], "page_id long, url string, html string, kept array<int>")
    links = extract.extract_pages(df, parts=("links",), raw=True).select("page_id", "url", "kept", F.explode("links").alias("l")).filter("l.url is not null")
    assert [(r.page_id, r.url, r.kept, r.l.url) for r in links.collect() if r.page_id == 1] == [(1, "https://example.com/a b", [1], "https://example.com/n"), (1, "https://example.com/a b", [1], "https://example.com/x")]
    assert _passes(links) == ["MapInArrow"]
    rows = extract.scrape_pages(df, '[{"name": "m", "selector": "a", "attr": "href", "many": true}]', "m", raw=True).filter("size(links) > 0")
    assert {r.page_id: (r.url, r.links[:1]) for r in rows.collect()}[1] == ("https://example.com/a b", ["https://example.com/n"])
    assert _passes(rows) == ["MapInArrow"]


def test_feed_parses_once(spark):
    from pyspark.sql import functions as F

    from spindrift.operators import frontier

    df = spark.createDataFrame([(1, "https://e.com/l", SHELF), (2, "https://e.com/m", None)], "place long, url string, html string")
    rows = extract.scrape_pages(df, '[{"name": "m", "selector": "a", "attr": "href"}]', "m").withColumn("links", F.when(F.size("links") > 0, F.col("links")))
    fed = frontier.feed_links(rows, spark.createDataFrame([], "url_key string"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert _passes(fed).count("MapInArrow") == 1
    assert sorted(r.url for r in fed.collect()) == ["https://e.com/l", "https://e.com/lights", "https://e.com/m"]
