"""URL functions: canonical form, politeness host, robots origin, key.

Most URLs are plain: no escapes, ports, user info or double slashes. They are rewritten with built-in expressions;
only the others pass through a vectorised Python function, which gets nulls in place of the plain ones.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track visits; the pattern of their names.
TRACKING = "utm_[a-z_]+|gclid|fbclid|mc_[ce]id|msclkid|igshid|ref|ref_src|yclid|_ga|_gl|s_cid|vero_id|spm"
#: File names that stand for their folder.
INDEX_FILE = r"/(index|default)\.(html?|php|aspx?)$"
DEFAULT_PORT = {"http": 80, "https": 443}

_TRACKING = re.compile(f"^({TRACKING})$", re.IGNORECASE)
_INDEX = re.compile(INDEX_FILE, re.IGNORECASE)
_PAIR = r"[A-Za-z0-9._~-]+(=[A-Za-z0-9._~-]*)?"
PLAIN = rf"^(?i:https?)://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*(/[\p{{L}}\p{{N}}._~,-]+)*/?(\?({_PAIR}(&{_PAIR})*)?)?(#[^\s]*)?$"


def canonical(raw: str | None, base: str | None = None) -> str | None:
    """The canonical form of any URL, None if it cannot be crawled."""
    if raw is None:
        return None
    try:
        parts = urlsplit((urljoin(base, raw) if base else raw).strip())
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if scheme not in DEFAULT_PORT or not host:
        return None
    netloc = host.removeprefix("www.")
    if port and port != DEFAULT_PORT[scheme]:
        netloc += f":{port}"
    path = _INDEX.sub("/", re.sub("/{2,}", "/", unquote(parts.path) or "/"))
    path = path.rstrip("/") or "/"
    pairs = sorted(kv for kv in parse_qsl(parts.query, keep_blank_values=True) if not _TRACKING.match(kv[0]))
    return urlunsplit((scheme, netloc, path, urlencode(pairs), ""))


@F.pandas_udf(T.StringType())
def canonical_udf(raw: pd.Series) -> pd.Series:
    return raw.map(canonical, na_action="ignore")


# Spark repeats a function that it holds for deterministic in each filter on its result, with a Python worker for each.
canonical_udf = canonical_udf.asNondeterministic()


@F.pandas_udf(T.StringType())
def canonical_from_udf(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def is_plain(url: Column) -> Column:
    return F.coalesce(url.rlike(PLAIN), F.lit(False))


def canonical_plain(url: Column) -> Column:
    """The canonical form of a plain URL, from built-in expressions alone."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), f"(?i){INDEX_FILE}", "/")
    path = F.regexp_replace(path, "/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.regexp_extract(p, "=(.*)$", 1)).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(split, lambda p: (p.k != "") & ~p.k.rlike(f"(?i)^({TRACKING})$")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p.k, F.lit("="), p.v)), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def normalize(url: Column) -> Column:
    """The canonical form of any URL."""
    return F.coalesce(F.when(is_plain(url), canonical_plain(url)), canonical_udf(F.when(~is_plain(url), url)))


def url_key(url: Column) -> Column:
    """SHA-256 of a canonical URL, hexadecimal: the key that tables are deduplicated by."""
    return F.sha2(url, 256)


def registrable_host(url: Column) -> Column:
    """Host for politeness: lower case, without `www.`, user info and port."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def robots_origin(url: Column) -> Column:
    """Scheme, host and port (unless the scheme's own) of the server whose robots.txt holds for a URL."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port))))
