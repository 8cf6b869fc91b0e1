"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the Jaccard likeness of their sets of word five-grams is at least 0.8. Words are runs of letters,
digits and underscores in lower case; a text of one to four words has one gram of them all, a text without words none.

1. Each text becomes its set of 64-bit gram hashes, a 128-bit key of that set, and a MinHash signature of 128 values.
   Texts with one set are one member from here on, with their number of copies.
2. Signatures are cut into 32 bands of 4 values. Members that agree in a band meet in its bucket: a pair at the threshold
   misses all bands with probability (1 - 0.8**4)**32 = 5e-8. Buckets of one member are dropped before signatures travel.
3. In a bucket, the signatures of pairs are compared 16 values at a time. After n values of which m agree, and with a
   uniform prior, the likeness is Beta(m + 1, n - m + 1); a pair whose probability of reaching the threshold falls below
   TOLERANCE is dropped. What is left links members to groups, as a forest: the edges of a bucket are fewer than its rows.
4. Groups are the connected components of those forests. Within a group every pair is verified on the exact sets, counts
   of common grams coming from products of 0/1 matrices; verified pairs are counted and joined there, so that pairs never
   become rows. A verified pair need not have been a candidate itself.
5. A class is a connected component of verified links; its id is the smallest document id in it.

Large buckets and groups are cut into blocks of members by a hash, and each two blocks are compared on their own: no task
holds more than two blocks, nothing is capped, and what does not fit one block is joined by components() again. A block
of a group holds about GROUP_BLOCK members and GROUP_BYTES of their sets; a group of n blocks sends each set n times, so
the bytes moved for one group of different near copies grow with the square of its size over that of a block.

Texts are read once and written once, beside their signatures, with a number for each row. From then on rows are numbers
and set keys: copies, null ids and repeated rows cost nothing, copies are joined back with hot keys spread (hot_join), and
members' texts, as well as the rows that stay, are picked where they lie (attach), so no text is ever shuffled.

Defined results: a null text, or one without words, is in a class of its own id without links; equal texts are linked
with each other; documents with null ids take part, and a class of such alone has a null id; rows repeated with one id
count as copies; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import append, attach, cut, hot_join, lean, name, numbered, table
from .components import components

GRAM = 5
LIKENESS = 0.8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Members of a block of a bucket, and of a group, and bytes of the sets of the latter.
BUCKET_BLOCK = 1_024
GROUP_BLOCK = 1_024
GROUP_BYTES = 8 << 20
#: Words whose hashes a task keeps; beyond, it starts anew. Only speed depends on it.
KEPT_WORDS = 300_000

_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(1, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, np.uint64)
_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Grams:
    """Texts to sorted arrays of different gram hashes."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def __call__(self, text: str, n: int = GRAM) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64)
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        hashes = list(map(kept.get, words))
        if None in hashes:
            for w in words:
                if w not in kept:
                    kept[w] = xxhash.xxh3_64_intdigest(w)
            hashes = list(map(kept.__getitem__, words))
        w = np.array(hashes, np.uint64)
        k = min(n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mixed(h + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def signature(grams: np.ndarray) -> np.ndarray:
    """The VALUES smallest values of a set under as many hash functions."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        seen = np.multiply.outer(_A, grams[i : i + 1024])
        seen += _B[:, None]
        np.minimum(out, seen.min(1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
    return h.view(np.int64)


def short(values: np.ndarray) -> bytes:
    """A byte of each value: what the comparison reads. Bytes of different values agree once in 256, which only keeps pairs."""
    return ((values >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes()


def set_key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


@cache
def least_agreeing(likeness: float = LIKENESS, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each STEP values: the fewest that must agree for the posterior probability of the likeness to reach tolerance.

    P(J >= t | m of n agree) = P(Binomial(n + 1, t) <= m) for a uniform prior.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * likeness**m * (1 - likeness) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def prune(s: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of rows (a, b) of the signatures s stay candidates; whole numbers into a and b."""
    left, agree = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        x, y = a[left], b[left]
        agree = agree + (s[x, k * STEP : (k + 1) * STEP] == s[y, k * STEP : (k + 1) * STEP]).sum(1, dtype=np.int32)
        fine = agree >= m
        left, agree = left[fine], agree[fine]
        if not len(left):
            break
    return left


class Forest:
    """Union-find; a tree's root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def joined(s: np.ndarray, side: np.ndarray, least: tuple[int, ...], cross: bool) -> np.ndarray:
    """Roots of the members of a large bucket joined by candidate pairs: of all pairs, or of those across its two sides."""
    forest = Forest(len(s))
    for i in range(0, len(s), 64):
        roots = forest.roots()
        rows = np.arange(i, min(i + 64, len(s)))
        agree = (s[rows, None, :STEP] == s[None, i:, :STEP]).sum(2, dtype=np.int8)
        open_ = (agree >= least[0]) & (roots[rows, None] != roots[None, i:])
        if cross:
            open_ &= side[rows, None] != side[None, i:]
        a, b = np.nonzero(open_)
        a, b = a + i, b + i
        for j in range(0, len(a), 100_000):  # pairs that others have joined meanwhile are not looked at
            roots = forest.roots()
            x, y = a[j : j + 100_000], b[j : j + 100_000]
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
            for k in prune(s, x, y, least):
                forest.join(int(x[k]), int(y[k]))
    return forest.roots()


@cache
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted batches whose first n_keys columns are the key."""
    key, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


EDGE = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


def candidate_edges(batches: Iterator[pa.RecordBatch], likeness: float = LIKENESS, small: int = 24) -> Iterator[pa.RecordBatch]:
    """Forest edges of buckets: rows band, i, j, side, key, sig, sorted by bucket and pair of blocks (i, j)."""
    least, schema = least_agreeing(likeness), to_arrow_schema(EDGE)

    def batch(u: list, v: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=schema)

    held: list[list[tuple]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        rows = [r for g in held for r in g]
        s = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, VALUES)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        starts = np.cumsum(sizes) - sizes
        parts = []
        for m in np.unique(sizes):
            x, y = _pairs(int(m))
            at = starts[sizes == m][:, None]
            parts.append(((at + x).ravel(), (at + y).ravel()))
        a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
        # The bytes cannot tell in which band a pair met first, as bytes of different values can agree: each bucket links its own.
        forest = Forest(len(rows))
        for k in prune(s, a, b, least):
            forest.join(int(a[k]), int(b[k]))
        roots = forest.roots()
        k = np.nonzero(roots != np.arange(len(rows)))[0]
        return batch([rows[x][1] for x in k], [rows[roots[x]][1] for x in k])

    for (_, i, j), rows in groups(batches, 3):
        if len(rows) < 2:
            continue
        if i == j and len(rows) <= small:
            held.append(rows)
            n += len(rows)
            if n >= 16_384:
                yield flush()
                held, n = [], 0
            continue
        s = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, VALUES)
        roots = joined(s, np.array([r[0] for r in rows]), least, i != j)
        k = [x for x in range(len(rows)) if roots[x] != x]
        yield batch([rows[x][1] for x in k], [rows[roots[x]][1] for x in k])
    if held:
        yield flush()


LINK = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("peer", T.BinaryType()), T.StructField("links", T.LongType())])


def common_grams(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of the number of common grams of each of a with each of b (None: of a as well), by products of 0/1 matrices."""
    sets = a if b is None else [*a, *b]
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    if b is None:
        both = times > 1
    else:
        left = np.bincount(at[owner < len(a)], minlength=len(times))
        both = (left > 0) & (left < times)
    shared = both[at]
    column, owner = (np.cumsum(both) - 1)[at[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(a), len(sets if b is None else b)), np.float32)  # whole numbers under 2**24
    n, width = int(both.sum()), 4096
    for lo in range(0, n, width):
        x, y = np.searchsorted(column, [lo, lo + width])
        held = np.zeros((len(sets), min(width, n - lo)), np.float32)
        held[owner[x:y], column[x:y] - lo] = 1
        out += held @ held.T if b is None else held[: len(a)] @ held[len(a) :].T
    return out


def linked(a: list[np.ndarray], likeness: float = LIKENESS, b: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of which sets of a are at least so alike with which of b (None: of a, but not with themselves), exactly."""
    x, y = (np.array([len(s) for s in side], np.int64) for side in (a, a if b is None else b))
    if b is None and len(a) <= 6:
        common = np.zeros((len(a), len(a)), np.int64)
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if min(x[i], x[j]) >= likeness * max(x[i], x[j]) - 1e-9:
                    common[i, j] = common[j, i] = len(np.intersect1d(a[i], a[j], assume_unique=True))
    else:
        common = common_grams(a, b).astype(np.int64)
    out = common >= likeness * (x[:, None] + y[None, :] - common) - 1e-9
    if b is None:
        np.fill_diagonal(out, False)
    return out


def verified(batches: Iterator[pa.RecordBatch], likeness: float = LIKENESS) -> Iterator[pa.RecordBatch]:
    """Links of groups: rows root, i, j, side, key, copies, grams, sorted by group and pair of blocks.

    A member's row has its number of links in this pair of blocks, each counted once for each copy of the other, and a
    peer that it is joined to: of a group in one block the class's root, else of a forest of this pair of blocks.
    """
    schema = to_arrow_schema(LINK)
    for (_, i, j), rows in groups(batches, 3):
        rows.sort(key=lambda r: r[0] != i)  # the first block's members, then the second's
        keys, sets = [r[1] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows]
        copies = np.array([r[2] for r in rows], np.float64)  # sums of these are exact below 2**53
        m = len(rows) if i == j else sum(r[0] == i for r in rows)
        forest = Forest(len(rows))
        if i == j:
            links = linked(sets, likeness)
            counts = links @ copies
        elif 0 < m < len(rows):
            links = linked(sets[:m], likeness, sets[m:])
            counts = np.concatenate([links @ copies[m:], links.T @ copies[:m]])
        else:  # one of the blocks has no members
            links, counts = np.zeros((0, 0), bool), np.zeros(len(rows))
        for a in range(len(links)):
            near = np.nonzero(links[a, a + 1 :])[0] + a + 1 if i == j else np.nonzero(links[a])[0] + m
            for x in near[np.unique(forest.up[near], return_index=True)[1]]:
                forest.join(a, int(x))
        roots = forest.roots()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[x] for x in roots], pa.binary()), pa.array(np.rint(counts).astype(np.int64))], schema=schema)


def _blocks(df: DataFrame, blocks: Column, key: str) -> DataFrame:
    """df with a row for each pair of blocks (i, j) that a member takes part in, of so many blocks that a hash deals them to."""
    each = df.withColumn("blocks", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "blocks")


def _signed(df: DataFrame, text_col: str) -> DataFrame:
    """df's rows, numbered, with the keys and signatures of their texts: written once."""
    return cut(append(numbered(df), [("row", text_col)], _SIGNED, _signer), "signed")


def _members(seen: DataFrame) -> DataFrame:
    """One row a set: its key, the row that stands for it (the smallest id's), its copies and its signature."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("w")
    each = seen.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("sig", "bands", "n_grams")])
    return cut(each.select("key", F.col("w.at").alias("at"), F.col("w.id").alias("first_id"), "copies", "sig", "bands", "n_grams"), "members")


def _groups(members: DataFrame, likeness: float) -> DataFrame:
    """node, root: the members that any bucket's candidate pairs join."""
    buckets = members.select("key", F.explode("bands").alias("band"))
    full = buckets.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = buckets.join(full, "band").join(members.select("key", "sig"), "key")
    dealt = _blocks(met, F.ceil(F.col("size") / BUCKET_BLOCK), "key").select("band", "i", "j", "side", "key", "sig")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return components(dealt.mapInArrow(lean(lambda batches: candidate_edges(batches, likeness)), EDGE), "u", "v")


def _links(signed: DataFrame, members: DataFrame, found: DataFrame, text_col: str, likeness: float) -> DataFrame:
    """key, peer, links of every two blocks of every group (verified)."""
    placed = cut(found.withColumnRenamed("node", "key").join(members.select("key", "at", "copies", "n_grams"), "key"), "placed")
    n_blocks = F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(8 * F.sum("n_grams") / GROUP_BYTES))
    sizes = cut(placed.groupBy("root").agg(n_blocks.alias("n_blocks"), F.count("*").alias("size")), "sizes")
    side = hot_join(placed, sizes, ["root"], "size").select("at", "root", "n_blocks", "key", "copies")
    texts = attach(signed.select("at", name(text_col, "row").alias("text")), side, only=True)
    grams = append(texts, ["text"], [T.StructField("grams", T.BinaryType())], _regrammer, keep=["root", "n_blocks", "key", "copies"])
    dealt = _blocks(grams, F.col("n_blocks"), "key").select("root", "i", "j", "side", "key", "copies", "grams")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return cut(dealt.mapInArrow(lean(lambda batches: verified(batches, likeness)), LINK), "links")


def _joined(signed: DataFrame, id_col: str, text_col: str, likeness: float) -> DataFrame:
    """at, id, hash, root (the class's key, null without words), class_id, n_links of every signed row."""
    seen = signed.select("at", name(id_col, "row").alias("id"), "hash", "key", "sig", "bands", "n_grams")
    members = _members(seen)
    links = _links(signed, members, _groups(members, likeness), text_col, likeness)
    counts = links.groupBy("key").agg(F.sum("links").alias("links"), F.count("*").alias("n"), F.min("peer").alias("peer"))
    # A member with one row was in a group of one block, and its peer is its class's root; the others are joined again.
    wide = links.join(counts.filter("n > 1").select("key"), "key", "left_semi")
    again = components(wide, "key", "peer").select(F.col("node").alias("key"), "root")
    classes = counts.join(again, "key", "left").select("key", "links", F.coalesce("root", F.when(F.col("n") == 1, F.col("peer")).otherwise(F.col("key"))).alias("root"))
    classes = members.select("key", "first_id", "copies").join(classes, "key", "left")
    classes = cut(classes.select("key", "first_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "classes")
    ids = cut(classes.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")), "ids")
    named = cut(hot_join(classes, ids, ["root"], "n").select("key", "copies", "root", "class_id", "n_links"), "named")
    rest = hot_join(seen.filter("key is not null").select("at", "id", "hash", "key"), named, ["key"], "copies")
    empty = seen.filter("key is null").select("at", "id", "hash", F.lit(None).cast("binary").alias("root"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rest.select("at", "id", "hash", "root", "class_id", "n_links").unionByName(empty)


def memberships(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS) -> DataFrame:
    """doc_id, root (the class's key, null without words), class_id, n_links of every row of df."""
    rows = _joined(_signed(df.select(name(id_col), name(text_col)), text_col), id_col, text_col, likeness)
    return rows.select(F.col("id").alias("doc_id"), "root", "class_id", "n_links")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS) -> DataFrame:
    """df's rows but for near copies: of each class the row with the smallest id (nulls last) stays, once.

    Rows without words are copies of nothing; they stay, rows repeated with one id and text once.
    """
    signed = _signed(df, text_col)
    rows = cut(_joined(signed, id_col, text_col, likeness).select("at", "id", "hash", "root"), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("w")
    best = rows.filter("root is not null").groupBy("root").agg(first).select("w.at")
    kept = best.unionByName(rows.filter("root is null").groupBy("id", "hash").agg(F.min("at").alias("at")).select("at"))
    return attach(signed.select("at", "row"), kept, only=True).select("row.*")


_SIGNED = [T.StructField("hash", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n_grams", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def _signer() -> Callable[[pa.Array], list]:
    grams = Grams()

    def run(texts: pa.Array) -> list:
        out = []
        for t in texts.to_pylist():
            g = grams(t or "")
            v = signature(g) if len(g) else None
            whole = None if t is None else int.from_bytes(xxhash.xxh3_64_digest(t), signed=True)
            out.append((whole, set_key(g), len(g), None if v is None else short(v), None if v is None else band_keys(v).tolist()))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in _SIGNED]

    return run


def _regrammer() -> Callable[[pa.Array], list]:
    """The gram sets of texts."""
    grams = Grams()
    return lambda texts: [[grams(t or "").tobytes() for t in texts.to_pylist()]]


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return memberships(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {GRAM}) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {GRAM - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {LIKENESS} * (x.n + y.n - c) - 1e-9),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id),
class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM class LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) USING (doc_id)"""
