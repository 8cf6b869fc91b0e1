"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased: in UTF-8, the bytes of digits, a-z and
everything beyond ASCII, so that normalising is one byte translation. A window is `width` consecutive words of an item,
or all words of an item with fewer. The automaton holds each window once, as ` w1 ... w8 `, with the items it belongs
to; it reads a document's words, joined by single spaces, once. A match's place gives its words, and these give code
point offsets in the original text.

Documents are never shuffled. The windows are: their number is counted first, and the automaton is built from at most
MOST_WINDOWS of them at a time; a larger benchmark takes several passes over the same rows, each of which adds to the
hit words and items of the passes before (window_passes). Texts are read whole.

Defined results: null texts have no words, hits or items (items_sha256 is that of the empty string); items that are null
or without words have no windows; several items with one id are one item, a null id is left out; repeated rows are
judged alike; input columns named as outputs are replaced, others may have any names; clean() returns all as they came.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, name, packed, table

WIDTH = 8
#: Different items of which a document holds windows, from which it is contaminated.
MIN_ITEMS = 2
#: Windows in one automaton, counted once for each item that has them (about 100 bytes each).
MOST_WINDOWS = 200_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

PASS_FIELDS = [
    T.StructField("words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.LongType())),
]


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def item_windows(words: list[bytes], width: int = WIDTH) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """window, items: the different windows of a benchmark (item_id, text) and the items of each."""

    def make() -> Callable[[pa.Array], list]:
        return lambda texts: [[[w.decode() for w in item_windows(normal_words(t or ""), width)] for t in texts.to_pylist()]]

    rows = append(benchmark.filter("item_id is not null"), ["text"], [T.StructField("w", T.ArrayType(T.StringType()))], make, keep=["item_id"])
    return rows.select(F.col("item_id").cast("long"), F.explode("w").alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))


def _automaton(held: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for window, items in held:
        w = f" {window} ".encode().decode("latin-1")
        a.add_word(w, (len(w), window.count(" ") + 1, items))
    a.make_automaton()
    return a


def scan(words: list[bytes], a: ahocorasick.Automaton) -> tuple[set[int], set[int]]:
    """(places of the words inside matches, items of the matches)."""
    hits: set[int] = set()
    items: set[int] = set()
    text = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    for end, (n, n_words, of) in a.iter(text):
        if not starts:
            at = 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
        first = bisect_right(starts, end + 1 - n) - 1
        hits.update(range(first, first + n_words))
        items.update(of)
    return hits, items


def window_passes(df: DataFrame, found: DataFrame, text_col: str, most: int = MOST_WINDOWS) -> DataFrame:
    """row, words, hits, items: df's rows as structs, the number of words, places of hit words, and items, over all windows."""
    n = found.agg(F.sum(F.size("items"))).first()[0] or 0
    shards = max(1, -(-n // most))
    out = packed(df)
    for k in range(shards):
        part = found if shards == 1 else found.filter(F.pmod(F.xxhash64("window"), F.lit(shards)) == k)
        held = spark_broadcast(df.sparkSession, sorted((r[0], sorted(r[1])) for r in part.collect()))

        def make(held=held) -> Callable[..., list]:
            a = _automaton(held.value) if held.value else None

            def run(texts: pa.Array, *before: pa.Array) -> list:
                out = []
                old = zip(*[b.to_pylist() for b in before], strict=True) if before else iter(lambda: (0, (), ()), None)
                for t, (_, hits, items) in zip(texts.to_pylist(), old):
                    w = normal_words(t or "")
                    h, i = scan(w, a) if a is not None and w else (set(), set())
                    out.append((len(w), sorted(h.union(hits)), sorted(i.union(items))))
                return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

            return run

        out = append(out, [("row", text_col), *[f.name for f in PASS_FIELDS if k]], PASS_FIELDS, make, keep=["row"])
    return out


def spark_broadcast(spark: SparkSession, value):  # noqa: ANN001, ANN201
    return spark.sparkContext.broadcast(value)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def original_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """[start, end) code points of the runs of hit words in the text as it came, in one pass over its bytes."""
    raw = text.encode()
    data = np.frombuffer(raw.translate(_TABLE), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # where each word starts and ends, in turn
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
    places = np.asarray(hits, np.int64)
    breaks = np.flatnonzero(np.diff(places) != 1)
    first, last = places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]
    return list(zip(chars[edges[2 * first]].tolist(), chars[edges[2 * last + 1]].tolist(), strict=True))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, min_items: int = MIN_ITEMS, most: int = MOST_WINDOWS, spans: bool = True) -> DataFrame:
    """df with n_words, n_hit, n_items, item_ids, spans (null unless asked for), items_sha256 and contaminated for its text column."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make() -> Callable[..., list]:
        def run(texts: pa.Array, n: pa.Array, hits: pa.Array, items: pa.Array) -> list:
            h, i = hits.to_pylist(), items.to_pylist()
            found = [original_spans(t.as_py(), x) if x else [] for t, x in zip(texts, h, strict=True)] if spans else [None] * len(h)
            return [n, list(map(len, h)), list(map(len, i)), items, pa.array(found, span)]

        return run

    passed = window_passes(df, windows(benchmark, width), text_col, most)
    out = append(passed, [("row", text_col), *[f.name for f in PASS_FIELDS]], FIELDS, make, keep=["row"])
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    out = out.withColumns({"items_sha256": F.sha2(ids, 256), "contaminated": F.col("n_items") >= min_items})
    made = [c for c in out.columns if c != "row"]
    return out.select(*[name(c, "row") for c in df.columns if c.lower() not in made], *made)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, most: int = MOST_WINDOWS) -> DataFrame:
    """df's rows that hold no window of the benchmark."""
    return window_passes(df, windows(benchmark, width), text_col, most).filter("size(items) = 0").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), spans=False).drop("text", "item_ids", "spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), {WIDTH}) AS n, w, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.win = array_to_string(w[i:i + dw.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""
