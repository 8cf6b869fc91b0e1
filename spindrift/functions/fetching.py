"""What a response means: outcome, error class, challenge, need for a browser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_BODY_BYTES, MIN_STATIC_WORDS

#: Markers of interstitial pages in the order in which they count, and what each is called.
CHALLENGES = (
    ("recaptcha", "recaptcha"),
    ("captcha", "captcha"),
    ("cloudflare", "cloudflare"),
    ("just a moment", "cloudflare_challenge"),
    ("checking your browser", "browser_check"),
    ("verify you are human", "human_verification"),
    ("access denied", "access_denied"),
    ("security check", "security_check"),
    ("bot detection", "bot_detection"),
    ("enable javascript and cookies", "browser_requirement"),
)
#: What an application's empty mount point looks like, and how markup is taken out.
APP_SHELL = r"""(?i)<(div|main)[^>]+id=["'](root|app|__next|__nuxt)["'][^>]*>\s*</"""
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
TAG = r"<[^>]+>"
#: Content types of pages.
HTML_TYPES = ("text/html", "application/xhtml+xml")


def http_error_class(status: Column) -> Column:
    return F.when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").when(status.between(400, 499), "client_error").otherwise("other")


def challenge_type(body: Column) -> Column:
    """The first marker that a body (text) holds; null if it holds none."""
    low = F.lower(body)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), kind) for m, kind in CHALLENGES])


def visible_words(body: Column) -> Column:
    shown = F.regexp_replace(F.regexp_replace(body, SCRIPT, ""), TAG, " ")
    return F.size(F.filter(F.split(shown, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))


def needs_render(body: Column) -> Column:
    """Whether a static page seems to lack its content: an empty mount point, or too few visible words."""
    return body.rlike(APP_SHELL) | (visible_words(body) < MIN_STATIC_WORDS)


def outcome(status: Column, content_type: Column, n_bytes: Column, error: Column, expect_html: bool = True) -> Column:
    """The outcome of an attempt, in the order in which the checks are made."""
    large = n_bytes > MAX_BODY_BYTES
    html = F.lit(False)
    for t in HTML_TYPES:
        html = html | F.contains(F.coalesce(content_type, F.lit("")), F.lit(t))
    out = F.when(error.isNotNull(), "network_error").when(status == 304, "not_modified").when((status >= 400) & large, "too_large").when(status >= 400, "http_error")
    if expect_html:
        out = out.when(~html, "non_html")
    return out.when(large, "too_large").otherwise("ok")


def has_body(result: Column, n_bytes: Column) -> Column:
    return (result == "ok") & (F.coalesce(n_bytes, F.lit(0)) > 0)
