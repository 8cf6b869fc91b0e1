"""Near duplicates by SimHash: pairs within a few bits, and the duplicate each row is suppressed for.

Rows with one fingerprint are one row of a join (their ids are kept as the smallest and the count), so copies cost
nothing. `banded` joins on all choices of three of six blocks of the 64 bits: fingerprints that differ in three bits
agree in three blocks whole, so no pair is missed, and a key of about 32 bits keeps chance meetings few at any scale.
Fingerprints of one key are compared in blocks of bounded size. Where only the smallest id around a fingerprint is asked
for, pairs never become rows (close_minima): each gives one row. The single bucket of the top byte, which misses pairs that differ there, is kept as an option.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fingerprints import hamming
from ..schemas import BUCKET_BITS, DUPLICATE_BITS
from ..sources.scratch import cut


def bucket(simhash: Column) -> Column:
    """The top byte, as a signed shift gives it."""
    return F.shiftright(simhash, 64 - BUCKET_BITS)


def masks(bits: int = DUPLICATE_BITS, agreeing: int = 3) -> list[int]:
    """Masks of `agreeing` whole blocks, in all choices from bits + agreeing blocks of the 64 bits, as signed numbers.

    Fingerprints that differ in at most `bits` bits agree in `agreeing` of the blocks at least, so under one mask whole.
    """
    n = bits + agreeing
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, agreeing))]


def keys(simhash: Column, bits: int = DUPLICATE_BITS, agreeing: int = 3) -> Column:
    """(band, value): what is left of a fingerprint under each mask."""
    return F.array(*[F.struct(F.lit(k).alias("band"), simhash.bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks(bits, agreeing))])


#: Fingerprints of a block of those that share a key.
BLOCK = 1_024
_NONE = np.iinfo(np.int64).max
#: Pairs that a task holds before it hands them on.
_PAIRS = 65_536


def _dealt(each: DataFrame, bits: int, banded: bool) -> DataFrame:
    """band, value, i, j, side and each's columns (simhash, values; a row each): fingerprints that share a key, cut into
    blocks by a hash, with those of blocks i and j together, so one key's fingerprints never gather in one task.

    Spark takes a row of `keyed` for one of `each`, so its own choice of join would send the keys of all to the driver.
    """
    own = keys(F.col("simhash"), bits) if banded else F.array(F.struct(F.lit(0).alias("band"), bucket(F.col("simhash")).cast("long").alias("value")))
    keyed = each.withColumn("k", F.explode(own)).select(*each.columns, "k.*")
    full = keyed.groupBy("band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1").drop("size")
    met = keyed.join(full.hint("merge"), ["band", "value"]).withColumn("side", F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    return met.select("band", "value", "i", "j", "side", *each.columns).repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of _dealt()'s rows, a batch at a time, and the edges of their groups, each of which is whole."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.cast(pa.int64()).fill_null(_NONE).to_numpy() for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
        changed = np.any([np.diff(c) != 0 for c in cols[:4]], 0) if len(cols[0]) > 1 else np.zeros(0, bool)
        edges = np.concatenate([[0], np.flatnonzero(changed) + 1])
        yield cols, edges
        rest = [c[edges[-1] :] for c in cols]  # the last group may go on
    if rest is not None and len(rest[0]):
        yield rest, np.array([0, len(rest[0])])


def _near(s: np.ndarray, side: np.ndarray, rows: slice, bits: int, cross: bool) -> np.ndarray:
    """For each of some fingerprints, which of the others (across the two sides, or all) are within `bits` bits."""
    close = np.bitwise_count((s[rows, None] ^ s[None, :]).view(np.uint64)) <= bits  # of signed numbers it counts the absolute value's
    return close & (side[rows, None] != side[None, :] if cross else s[rows, None] != s[None, :])


def _minima(s: np.ndarray, side: np.ndarray, values: list[np.ndarray], bits: int, cross: bool) -> list[np.ndarray]:
    """For each fingerprint the smallest of each value among the others (across the two sides, or all) within `bits` bits."""
    out = [np.full(len(s), _NONE) for _ in values]
    for i in range(0, len(s), 256):
        rows = slice(i, i + 256)
        close = _near(s, side, rows, bits, cross)
        for o, v in zip(out, values, strict=True):
            o[rows] = np.where(close, v[None, :], _NONE).min(1)
    return out


def close_fingerprints(rows: DataFrame, bits: int = DUPLICATE_BITS, banded: bool = True, simhash_col: str = "simhash") -> DataFrame:
    """a, b: the different fingerprints, a < b, that differ in at most `bits` bits; of the keys that a pair shares, the first gives it."""
    each = rows.filter(F.col(simhash_col).isNotNull()).select(F.col(simhash_col).alias("simhash")).distinct()
    cuts = np.array(masks(bits) if banded else [0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for cols, edges in _groups(batches):
            for lo, hi in zip(edges, edges[1:], strict=False):
                s, side, band, cross = cols[5][lo:hi], cols[4][lo:hi], cols[0][lo], cols[2][lo] != cols[3][lo]
                for i in range(0, len(s), 256):
                    x, y = np.nonzero(_near(s, side, slice(i, i + 256), bits, cross))
                    a, b = s[x + i], s[y]
                    a, b = a[a < b], b[a < b]
                    first = (((a ^ b)[:, None] & cuts[None, :]) == 0).argmax(1) == band
                    found.append((a[first], b[first]))
                    n += len(found[-1][0])
                    if n >= _PAIRS:
                        yield _pairs(found)
                        found, n = [], 0
        if n:
            yield _pairs(found)

    return _dealt(each, bits, banded).mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])


def close_minima(least: DataFrame, values: list[str], bits: int = DUPLICATE_BITS, banded: bool = True) -> DataFrame:
    """simhash and the smallest of each value (long) among the other fingerprints of least (simhash, values; a row each)
    that differ in at most `bits` bits."""
    n = len(values)
    each = least.select("simhash", *[F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)])
    out = T.StructType([T.StructField("simhash", T.LongType()), *[T.StructField(v, T.LongType()) for v in values]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, edges in _groups(batches):
            found = [[np.empty(0, np.int64)] for _ in range(n + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                s = cols[5][a:b]
                mins = _minima(s, cols[4][a:b], [c[a:b] for c in cols[6:]], bits, cols[2][a] != cols[3][a])
                hit = np.any([m != _NONE for m in mins], 0)
                for f, m in zip(found, [s, *mins], strict=True):
                    f.append(m[hit])
            done = [np.concatenate(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), *[pa.array(d, mask=d == _NONE) for d in done[1:]]], names=out.names)

    return _dealt(each, bits, banded).mapInArrow(run, out).groupBy("simhash").agg(*[F.min(v).alias(v) for v in values])


def first_duplicates(rows: DataFrame, id_col: str, bits: int = DUPLICATE_BITS, banded: bool = True, indexed: DataFrame | None = None) -> DataFrame:
    """id, duplicate_of: rows that have a near duplicate, with its smallest id (ids are whole numbers).

    A row is a duplicate of one with a smaller id, or of any that is indexed already (indexed: id, simhash), so two rows
    never suppress each other. Ids meet through their fingerprints, each of which has one smallest id.
    """
    own = rows.select(F.col(id_col).alias("id"), "simhash").filter("simhash is not null")
    ground = own.withColumn("done", F.lit(False)) if indexed is None else own.withColumn("done", F.lit(False)).unionByName(indexed.select(F.col(id_col).alias("id"), "simhash", F.lit(True).alias("done")).filter("simhash is not null"))
    least = cut(ground.groupBy("simhash").agg(F.min(F.when(F.col("done"), F.col("id"))).alias("d"), F.min(F.when(~F.col("done"), F.col("id"))).alias("l")), "least")
    # For each fingerprint: the smallest ids around it, its own among them. The own row's id is never smaller than itself.
    near = close_minima(least, ["d", "l"], bits, banded).select("simhash", F.col("d").alias("nd"), F.col("l").alias("nl"))
    around = least.join(near, "simhash", "left").select("simhash", F.least("d", "nd").alias("d"), F.least("l", "nl").alias("l"))
    found = own.join(around, "simhash").select("id", F.least("d", F.when(F.col("l") < F.col("id"), F.col("l"))).alias("duplicate_of"))
    return found.filter("duplicate_of is not null").withColumnRenamed("id", id_col)


def any_duplicates(rows: DataFrame, id_col: str, bits: int = DUPLICATE_BITS, banded: bool = True) -> DataFrame:
    """id, duplicate_of: the smallest other id among near duplicates of any state, so that copies may suppress each other."""
    own = rows.select(F.col(id_col).alias("id"), "simhash").filter("simhash is not null")
    # The two smallest ids of a fingerprint are enough: one of them is not the row's own.
    first = own.groupBy("simhash").agg(F.min("id").alias("first"))
    second = own.join(first, "simhash").filter("id <> first").groupBy("simhash").agg(F.min("id").alias("second"))
    two = cut(first.join(second, "simhash", "left"), "two")
    near = close_minima(two.select("simhash", "first"), ["first"], bits, banded).withColumnRenamed("first", "near")
    found = own.join(two.join(near, "simhash", "left"), "simhash")
    return found.select(F.col("id").alias(id_col), F.least("near", F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))).alias("duplicate_of")).filter("duplicate_of is not null")
