"""Pages to documents and links, and pages to records by declared fields.

HTML needs a parser, so each is one Arrow-batched pass over the rows with all results of a page in one struct: a page is
parsed once, its elements are listed by tag in one walk, and only the parts that are asked for are made. What follows
(hashes, counts, joins) is built in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as dom
from ..functions.fingerprints import simhash_of
from ..functions.passes import append, name
from ..functions.urls import canonical

#: Fixed value: elements that are not part of a page's content.
BOILERPLATE = "script, style, nav, header, footer, aside, noscript, iframe, form"
_HIDDEN = frozenset(BOILERPLATE.split(", "))

LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "anchor_text", "rel")])
PAGE = T.StructType(
    [
        T.StructField("canonical_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("simhash", T.LongType()),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)


def stripped(node: dom.Node) -> str:
    return "".join(t.strip() for t in node.texts())


def _by_tag(tree: dom.Node) -> dict[str, list[dom.Node]]:
    """The elements of a tree by their tag, in document order."""
    found: dict[str, list[dom.Node]] = {}
    for n in tree.walk():
        found.setdefault(n.tag, []).append(n)
    return found


def _is_shown(node: dom.Node) -> bool:
    up: dom.Node | None = node
    while up is not None:
        if up.tag in _HIDDEN:
            return False
        up = up.parent
    return True


def _shown_text(node: dom.Node) -> str:
    """The texts below an element but for boilerplate, joined and with single spaces."""
    parts: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in _HIDDEN:
            todo.extend(reversed(x.children))
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def _links(anchors: list[dom.Node], base: str) -> list[dict]:
    """The canonical URLs that anchors lead to, each once, with the first anchor's text."""
    links: dict[str, dict] = {}
    seen: set[str] = set()
    for a in anchors:
        href = a.attrs.get("href")
        if href and href not in seen:
            seen.add(href)
            if (url := canonical(href, base)) and url not in links:
                links[url] = {"url": url, "anchor_text": stripped(a) or None, "rel": a.attrs.get("rel")}
    return list(links.values())


def page_of(body: str | None, base: str, parts: tuple[str, ...] = tuple(PAGE.names)) -> dict | None:
    """What a page says, of the parts that are asked for; None without a body or where it asks not to be indexed."""
    if not body:
        return None
    by = _by_tag(dom.parse(body))
    first = lambda tag, test, name: next((n.attrs.get(name) for n in by.get(tag, ()) if test(n.attrs)), None)
    shown = lambda *tags: next((n for tag in tags for n in by.get(tag, ()) if _is_shown(n)), None)
    if "noindex" in (first("meta", lambda a: a.get("name") == "robots", "content") or "").lower():
        return None
    out: dict = {}
    if "canonical_url" in parts:
        href = first("link", lambda a: a.get("rel") == "canonical", "href")
        out["canonical_url"] = (canonical(href, base) if href else None) or base
    if "title" in parts:
        title = shown("title")
        out["title"] = stripped(title) if title else None
    if "description" in parts:
        out["description"] = first("meta", lambda a: a.get("name") == "description", "content")
    if "text" in parts or "simhash" in parts:
        content = shown("main", "article", "body")
        out["text"] = _shown_text(content) if content else ""
    if "lang" in parts:
        lang = first("html", lambda a: True, "lang")
        out["lang"] = lang.split("-")[0].lower() if lang else None
    if "simhash" in parts:
        out["simhash"] = simhash_of(out["text"])
    if "links" in parts:
        out["links"] = _links(by.get("a", []), base)
    return out


def _read(rows: DataFrame, inputs: list[str], fields: list[T.StructField], one: Callable[..., dict | None], raw: bool, left_out: set[str]) -> DataFrame:
    """rows but for the columns left out, with _found and the fields of what `one` makes of each; the first two inputs are
    the html and the url. raw: urls become canonical on the way. Spark sees a pass that it can't repeat for a filter."""
    url_col = inputs[1]
    kept = [c for c in rows.columns if c not in left_out]
    put = [T.StructField("_found", T.BooleanType()), *([T.StructField("_url", T.StringType())] if raw else []), *fields]

    def make() -> Callable[..., list]:
        def run(*columns: pa.Array) -> list:
            bodies, urls, *more = (c.to_pylist() for c in columns)
            urls = [canonical(u) for u in urls] if raw else urls
            out: list[list] = [[] for _ in fields]
            found = []
            for x in zip(bodies, urls, *more, strict=True):
                r = one(*x)
                found.append(r is not None)
                for o, f in zip(out, fields, strict=True):
                    o.append(r and r[f.name])
            return [found, *([urls] if raw else []), *out]

        return run

    done = append(rows, inputs, put, make, keep=kept)
    return done.select("_found", *[F.col("_url").alias(c) if raw and c == url_col else name(c) for c in kept], *[f.name for f in fields])


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", parts: tuple[str, ...] = tuple(PAGE.names), raw: bool = False) -> DataFrame:
    """pages but for their html, with what they say (of the parts that are asked for; with the text, also word_count and
    content_sha256); pages without content are left out. raw: their urls are not canonical yet."""
    fields = [f for f in PAGE.fields if f.name in parts]
    out = _read(pages, [html_col, url_col], fields, lambda body, base: page_of(body, base, parts), raw, {html_col}).filter("_found").drop("_found")
    if "text" not in parts:
        return out
    words = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " ")))
    return out.withColumns({"word_count": words, "content_sha256": F.sha2("text", 256)})


@dataclass(frozen=True)
class Field:
    """A field of a record: a selector and what to take from what it selects."""

    name: str
    selector: str
    selector_type: str = "css"
    attr: str | None = None
    many: bool = False
    fields: tuple[Field, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.selector_type not in ("css", "xpath"):
            raise ValueError(f"selector_type of {self.name} is neither css nor xpath")

    @classmethod
    def read(cls, d: dict) -> Field:
        return cls(d["name"], d["selector"], d.get("selector_type", "css"), d.get("attr"), bool(d.get("many", False)), tuple(cls.read(x) for x in d.get("fields") or ()))


def read_fields(text: str) -> list[Field]:
    return [Field.read(d) for d in json.loads(text)]


@lru_cache(1_000)
def _read_once(text: str) -> list[Field]:
    return read_fields(text)


def _taken(found: dom.Node | str, attr: str | None) -> str | None:
    if isinstance(found, str):
        return found.strip() or None
    raw = found.attrs.get(attr) if attr else found.text()
    return raw.strip() if raw else None


def record_of(node: dom.Node, fields: list[Field] | tuple[Field, ...]) -> dict:
    out: dict = {}
    for f in fields:
        found = dom.xpath(node, f.selector) if f.selector_type == "xpath" else dom.css(node, f.selector)
        take = (lambda m, f=f: record_of(m, f.fields)) if f.fields else (lambda m, f=f: _taken(m, f.attr))
        values = [take(m) for m in (found if f.many else found[:1])]
        out[f.name] = [v for v in values if v is not None] if f.many else values[0] if values else None
    return out


RECORD = T.StructType([T.StructField("data", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


def scrape_record(body: str | None, base: str, fields: list[Field], link_field: str | None) -> dict | None:
    """{data, links} of a page: its fields as JSON, and the canonical URLs of the field that holds links.

    References need their semicolon here, as in the reference's scraper, whose parser is libxml2; page_of() reads them as HTML does."""
    if not body:
        return None
    tree = dom.parse(body, closed=True)
    for n in tree.walk():
        for a in ("href", "src", "action"):
            if n.attrs.get(a):
                n.attrs[a] = urljoin(base, n.attrs[a])
    data = record_of(tree, fields)
    raw = data.get(link_field) if link_field else None
    hrefs = raw if isinstance(raw, list) else [raw] if raw else []
    return {"data": json.dumps(data, ensure_ascii=False), "links": [u for h in hrefs if h and (u := canonical(h, base))]}


def scrape_targets(targets: DataFrame, url_col: str = "url", html_col: str = "html", raw: bool = False) -> DataFrame:
    """targets (each with its spec's `fields` and `link_field`) but for their html, with data (JSON, null where a page
    cannot be read) and links: one pass for all specs, whose fields are read once a process. raw: as in extract_pages()."""
    none = {"data": None, "links": []}

    def scrape(body: str | None, base: str, fields: str | None, link_field: str | None) -> dict:
        return none if fields is None else scrape_record(body, base, _read_once(fields), link_field) or none

    return _read(targets, [html_col, url_col, "fields", "link_field"], RECORD.fields, scrape, raw, {html_col, "fields", "link_field"}).drop("_found")


def scrape_pages(targets: DataFrame, fields: str, link_field: str | None = None, url_col: str = "url", html_col: str = "html", raw: bool = False) -> DataFrame:
    """As scrape_targets(), for targets of one spec."""
    read_fields(fields)
    return scrape_targets(targets.withColumns({"fields": F.lit(fields), "link_field": F.lit(link_field).cast("string")}), url_col, html_col, raw)


def blob_key(prefix: str, host: Column, row_id: Column, ext: str) -> Column:
    """Where a payload is kept: prefix/shard/host/id.ext.zst, the shard from the id's SHA-256."""
    text = row_id.cast("string")
    return F.concat_ws("/", F.lit(prefix), F.substring(F.sha2(text, 256), 1, 2), host, F.concat(text, F.lit(f".{ext}.zst")))
