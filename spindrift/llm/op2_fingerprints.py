"""Lempel-Ziv phrase fingerprints.

A text is parsed left to right into phrases, each the shortest run of code points that is not in the dictionary yet, and
enters the dictionary (the last one may be known). The set of phrases is what a compressor would have learnt of the
text. Phrases are hashed all at once: with prefix sums of c * P**k modulo 2**64, a phrase's polynomial hash is a
difference divided by a power of P, whatever its length. The fingerprint is the SIZE smallest of the mixed hashes, and
the likeness of two fingerprints is the share of the smallest SIZE values of their union that both hold (bottom-k
estimate of the Jaccard likeness of the phrase sets).

A text and an edit of it that begins alike share the parse of the common beginning: the edited text's parse goes on from
the dictionary at that place, so that each text is parsed once and half of it once more.

The neighbour of a document is the next in descending id, of equal ids in descending hash of the text. This order is cut
into ranges, at places that a bounded sample of its keys gives; a range is one partition, sorted, and streamed with one
row of look-ahead. The first row of the next range is sent along as an extra row of the one before it, so texts move once,
and a row's neighbour needs no join. Memory holds two texts. An id, or null, that a third of all rows have is cut by the
hash; only rows alike in id and text stay together.

Defined results: null texts are empty; a text without phrases has an empty fingerprint, and two of these are alike (1),
one and another are not (0). Null ids come last; equal ids are ordered by their text's xxhash64, then by text; repeated
rows are neighbours of each other; a single document is its own neighbour; an empty table gives no rows; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, name, slices, table

#: Values in a fingerprint, 32 bits each.
SIZE = 128
#: Documents in a range, about, up to MOST_RANGES ranges (whose cuts go to every task); with more documents, ranges grow.
RANGE_ROWS = 2_000
MOST_RANGES = 100_000
#: Sampled keys for each range.
SAMPLED = 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0:1] = 1
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Table:
    """Powers of P and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.p, self.inverse = _powers(1, _P), _powers(1, _P_INVERSE)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.p):
            n = max(n, 2 * len(self.p))
            self.p, self.inverse = _powers(n, _P), _powers(n, _P_INVERSE)
        return self.p, self.inverse


_TABLE = _Table()


def parse(text: str, known: set[str], phrase: str, ends: list[int], start: int = 0) -> str:
    """Go on with a parse: add phrases to `known` and the places where they end to `ends`; give the unfinished phrase."""
    add, put = known.add, ends.append
    for i, c in enumerate(text, start + 1):
        phrase += c
        if phrase not in known:
            add(phrase)
            put(i)
            phrase = ""
    return phrase


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A 32-bit hash of each phrase of a parse that covers the text; the last may be unfinished."""
    n = len(text)
    if not n:
        return np.empty(0, np.uint32)
    cuts = np.asarray(ends if ends and ends[-1] == n else [*ends, n], np.int64)
    p, inverse = _TABLE.get(n)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * p[:n], out=sums[1:])
    starts = np.concatenate([np.zeros(1, np.int64), cuts[:-1]])
    h = (sums[cuts] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h.astype(np.uint32)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The `size` smallest different values, sorted."""
    if len(hashes) > 4 * size:  # repeats are few: a phrase is new but for the last, and hashes rarely meet
        hashes = np.partition(hashes, 2 * size)[: 2 * size + 1]
    return np.unique(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def fingerprint(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, set(), "", ends)
    return smallest(phrase_hashes(text, ends))


def edit(text: str, other: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_edit(text: str, other: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(fingerprint, fingerprint of the edited text, edited text), from one parse of what both begin with."""
    edited = edit(text, other)
    same = len(text) - len(text) // 2
    ends: list[int] = []
    known: set[str] = set()
    phrase = parse(text[:same], known, "", ends)
    half_known, half_ends = known.copy(), ends.copy()
    parse(text[same:], known, phrase, ends, same)
    parse(edited[same:], half_known, phrase, half_ends, same)
    return smallest(phrase_hashes(text, ends)), smallest(phrase_hashes(edited, half_ends)), edited


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def sort_keys(known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """17 bytes each that sort as (id, hash) do, null ids first."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = known
    for i, v in ((1, ids), (9, hashes)):
        out[:, i : i + 8] = (v.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def cuts_of(keys: DataFrame, range_rows: int) -> np.ndarray:
    """Sort keys that cut the rows of keys (known, id, h) into ranges, from a sample of about SAMPLED keys a range."""
    n = keys.count()
    k = min(MOST_RANGES, -(-n // range_rows))
    if k < 2:
        return np.empty(0, "S17")
    drawn = keys.filter(F.pmod(F.xxhash64("known", "id", "h"), F.lit(max(1, n // (SAMPLED * k)))) == 0)
    got = drawn.groupBy("known", "id", "h").count().toArrow()
    order = sort_keys(*[got.column(c).to_numpy() for c in ("known", "id", "h")])
    by = np.argsort(order)
    order, below = order[by], np.cumsum(got.column("count").to_numpy()[by])
    if not len(order):
        return order
    return np.unique(order[np.minimum(np.searchsorted(below, below[-1] * np.arange(1, k) / k), len(order) - 1)])


def with_neighbour_rows(df: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, h, part, extra: ranges of rows in descending order, each followed by the first row of the next range.

    `part` counts ranges from the largest ids on. A null id is below all others. The last range is followed by the first
    row of all.
    """
    rows = df.select(name(id_col).cast("long").alias("doc_id"), F.coalesce(name(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    place = [F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h"]
    keys = cut(rows.select(*place), "keys")
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(cuts_of(keys, range_rows))

    @F.pandas_udf("int")
    def part_of(known, ids, hashes):  # noqa: ANN001, ANN202
        at = np.searchsorted(held.value, sort_keys(known.to_numpy(bool), ids.to_numpy(), hashes.to_numpy()), side="right")
        return ids.__class__(len(held.value) - at)

    # Each range goes on with the first row of the next one that has rows. There are at most MOST_RANGES.
    first = F.max(F.struct("known", "id", "h")).alias("r")
    tops = {r[0]: tuple(r[1:]) for r in keys.withColumn("part", part_of("known", "id", "h")).groupBy("part").agg(first).select("part", "r.*").collect()}
    ranged = rows.withColumn("part", part_of(*[F.coalesce("doc_id", F.lit(0)) if c == "id" else F.col("doc_id").isNotNull() if c == "known" else F.col(c) for c in ("known", "id", "h")])).withColumn("extra", F.lit(False))
    if not tops:
        return ranged
    order = sorted(tops)
    follows = dict(zip(order[1:] + order[:1], order, strict=True))
    lead = spark.createDataFrame([(*tops[p], follows[p]) for p in order], "known boolean, id long, hash long, goes_to int")
    on = (F.col("doc_id").isNotNull() == F.col("known")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("h") == F.col("hash"))
    one = rows.join(F.broadcast(lead), on).groupBy("goes_to").agg(F.max(F.struct("text", "doc_id", "h")).alias("r"))
    return ranged.unionByName(one.select("r.doc_id", "r.text", "r.h", F.col("goes_to").alias("part"), F.lit(True).alias("extra")))


def fingerprint_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The fingerprint of every text, of its edit with the next text's beginning, and how alike they are."""
    schema = to_arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose neighbour comes next: (part, id, text)
        waiting: tuple | None = None  # its values but near_next
        out: list[tuple] = []

        def close(sketch: np.ndarray) -> None:
            out.append((*waiting[:-1], likeness(waiting[-1], sketch)))

        for b in slices(batches, 4 << 20):
            for part, doc, text, extra in zip(*[b.column(c).to_pylist() for c in ("part", "doc_id", "text", "extra")], strict=True):
                if held is not None and held[0] == part:
                    sketch, changed, edited = with_edit(held[2], text)
                    if waiting is not None:
                        close(sketch)
                    waiting = (held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), as_text(sketch), as_text(changed), likeness(sketch, changed), sketch)
                    if extra:
                        close(fingerprint(text))
                        waiting = None
                held = None if extra else (part, doc, text)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()

    rows = with_neighbour_rows(df, id_col, text_col, range_rows)
    dealt = rows.repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(run, OUT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, edited with the next one's beginning."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
