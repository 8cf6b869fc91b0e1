"""URL filters: a weighted URL vocabulary on one Aho-Corasick automaton, behind host and path rules.

A term is strict or soft and has a weight. A url is read percent-decoded, with A-Z lower-cased, and a term counts once
however often it occurs, only where it stands alone: the characters beside it are no letters or digits. One strict term
rejects a url; so do soft ones, if at least SOFT_TERMS different ones occur and their weights reach LIMIT. Host rules come
first; where none fits, the vocabulary decides.

The vocabulary is a parameter: a sequence of Terms, or a table or file (term, strict, weight) of at most MOST_TERMS terms,
which is checked. The one that is built in follows from stems in four languages and the endings that urls join to them
(vocabulary()), some hundred terms. It is sent to every task and becomes one automaton there. One row in, one row out, no
shuffle.

Defined results: null url or none with `://`: host and path empty, no rule, and the vocabulary still reads the whole
string (null: nothing), so such rows are allowed unless terms occur. Terms that are null or empty are left out; of terms
given twice the strict or heavier one holds; equally long rules go by the longer host, then by place. Urls of any length
are read whole; repeated rows are judged alike; an input column named as an output is replaced, others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append, table


class Term(NamedTuple):
    text: str
    strict: bool
    weight: float


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Stems of the built-in vocabulary in English, German, French and Spanish, and the endings that each kind takes.
STRICT = (
    "porn porno xxx hentai milf bdsm gangbang bukkake camgirl camsex cybersex sexcam nsfw bestiality fetish upskirt deepthroat "
    "bordell hure hobbyhure nutte ficken fickt wichsen titten pornofilm baise salope partouze pute zorra follar culona tetona pornografia "
    "warez keygen crackz serialz nulled darknetmarket"
).split()
STRICT_ENDINGS = ("", "s", "site", "sites", "tube", "video", "videos", "hub", "live")
STRONG = (
    "adult sex sexe sexo nude nackt nue desnuda erotic erotik erotique erotica escort striptease swinger viagra cialis levitra kamagra steroid "
    "casino kasino poker roulette blackjack baccarat jackpot slot sportsbook bookmaker betting wetten wette sportwetten pari apuesta tragaperras spielautomat "
    "torrent crack cracked malware phishing replica"
).split()
STRONG_ENDINGS = ("", "s", "online", "24", "club")
WEAK = (
    "x win winner gewinn gain ganar bonus free gratis gratuit hot girl girls boys teen teens mature babe babes cam webcam chat date dating hookup flirt rencontre citas kontakte "
    "lottery lotto loteria bet bets odds bingo spins spin dice vip cash money geld dinero argent loan credit kredit pills pharmacy pharma cheap discount billig "
    "download downloads hack hacks cheats serial leaked stream streaming"
).split()
WEIGHTS = {"strict": 3.0, "strong": 1.5, "weak": 1.0}
#: What soft terms must reach to reject a url: a strong and a weak one do, two weak ones do not.
LIMIT = 2.5
SOFT_TERMS = 2
MOST_TERMS = 50_000

#: The rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

FIELDS = [
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("strict_hits", T.LongType()),
    T.StructField("soft_hits", T.LongType()),
    T.StructField("soft_weight", T.DoubleType()),
]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first `://` up to / ? # or the end, A-Z lower-cased; path then up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def rule_for(host: str, path: str, by_host: dict[str, list[Rule]]) -> Rule | None:
    """The longest rule whose host is this host or a parent domain of it and whose path starts the url's path."""
    best, at = None, host
    while at:
        for r in by_host.get(at, ()):
            if path.startswith(r.path) and (best is None or (len(r.name), len(r.host)) > (len(best.name), len(best.host))):
                best = r
        at = at.partition(".")[2]
    return best


@cache
def vocabulary() -> tuple[Term, ...]:
    """The built-in terms: each stem with each ending of its kind; a term that several rules give is its strictest."""
    made: dict[str, Term] = {}
    for stems, endings, strict, kind in ((WEAK, ("",), False, "weak"), (STRONG, STRONG_ENDINGS, False, "strong"), (STRICT, STRICT_ENDINGS, True, "strict")):
        made |= {stem + end: Term(stem + end, strict, WEIGHTS[kind]) for stem in stems for end in endings}
    return tuple(sorted(made.values()))


def read_terms(given: DataFrame, most: int = MOST_TERMS) -> tuple[Term, ...]:
    """A vocabulary from a table (term, strict, weight); ValueError if it has more than `most` rows."""
    rows = given.select("term", "strict", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary has at most {most} terms")
    made: dict[str, Term] = {}
    for t in sorted((r.term.strip().translate(_LOWER), bool(r.strict), 1.0 if r.weight is None else float(r.weight)) for r in rows if r.term and r.term.strip()):
        made[t[0]] = Term(*t)
    return tuple(made.values())


def automaton(terms: Sequence[Term]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in terms:
        a.add_word(term.text, (len(term.text), term))
    a.make_automaton()
    return a


def find_terms(url: str, a: ahocorasick.Automaton) -> set[Term]:
    """The different terms that stand alone in a url."""
    text, found = unquote(url).translate(_LOWER), set()
    for end, (n, term) in a.iter(text):
        before = end - n
        if (before < 0 or not text[before].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found.add(term)
    return found


def filter_urls(df: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES, terms: Sequence[Term] | DataFrame | str | None = None, limit: float = LIMIT, soft_terms: int = SOFT_TERMS) -> DataFrame:
    """df with host, path, rule, verdict, strict_hits, soft_hits and soft_weight for its url column.

    terms: a vocabulary, or a table or the path of a Parquet file of one; None for the built-in one.
    """
    if isinstance(terms, str):
        terms = df.sparkSession.read.parquet(terms)
    known = vocabulary() if terms is None else read_terms(terms) if isinstance(terms, DataFrame) else tuple(terms)
    if len(known) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    held = df.sparkSession.sparkContext.broadcast((tuple(rules), known))

    def make() -> Callable[[pa.Array], list]:
        rules, known = held.value
        a = automaton(known) if known else None
        by_host: dict[str, list[Rule]] = {}
        for r in rules:
            by_host.setdefault(r.host, []).append(r)

        def judge(urls: pa.Array) -> list:
            rows = []
            for url in urls.to_pylist():
                host, path = split_url(url)
                rule = rule_for(host, path, by_host)
                found = find_terms(url, a) if url and a else set()
                n_strict = sum(t.strict for t in found)
                n_soft, weight = len(found) - n_strict, sum(sorted(t.weight for t in found if not t.strict))
                bad = n_strict > 0 or (n_soft >= soft_terms and weight >= limit)
                rows.append((host, path, rule and rule.name, rule.verdict if rule else "block" if bad else "allow", n_strict, n_soft, float(weight)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(FIELDS)

        return judge

    return append(df, [url_col], FIELDS, make)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: host, path, the rule that holds and the verdict."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _oracle() -> str:
    host, path = "regexp_extract(url, '^.*?://([^/?#]*)', 1)", "regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1)"
    fits = " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: -len(r.name)))
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = ", ".join(f"('{t.text}', {t.strict}, {t.weight})" for t in vocabulary())
    return f"""
WITH v(term, strict, weight) AS (VALUES {terms}),
s AS (SELECT page_id, translate({host}, '{upper}', '{lower}') AS host, {path} AS path,
  translate(url_decode(url), '{upper}', '{lower}') AS low FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS term FROM s),
h AS (SELECT page_id, count(*) FILTER (strict) AS strict_hits, count(*) FILTER (NOT strict) AS soft_hits,
  coalesce(sum(weight) FILTER (NOT strict), 0)::DOUBLE AS soft_weight FROM w JOIN v USING (term) GROUP BY page_id),
t AS (SELECT page_id, host, path, CASE {fits} END AS rule, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits,
  coalesce(soft_weight, 0)::DOUBLE AS soft_weight FROM s LEFT JOIN h USING (page_id))
SELECT page_id, host, path, rule,
  CASE {verdict} WHEN strict_hits > 0 OR (soft_hits >= {SOFT_TERMS} AND soft_weight >= {LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits, soft_weight FROM t"""


ORACLE_SQL = _oracle()
