"""The n-gram join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import op4_ngram_join as op4
from spindrift.llm.components import components


def make_texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))] + (passage if k % 2 else [])
        rows += [(len(rows), " ".join(base))] * 1
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    texts = [t for _, t in rows]
    rows += [(1000, texts[0].upper()), (1000, texts[0].upper()), (None, texts[3]), (None, None), (1001, ""), (1002, "?!"), (1003, "one two"), (1004, "One, two"), (5, "id repeated with another text " * 3), (1005, "long " * 30_000 + "end"), (None, "alone without an id at all"), (None, "Alone without an id at all!")]
    return rows


def brute(rows):
    grams = op4.Grams()
    sets = [frozenset(grams(t or "").tolist()) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    least = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in classes.items()}
    return sorted(repr((rows[i][0], least[find(i)], links[i])) for i in range(len(rows))), classes, sets


@pytest.mark.parametrize("block", [3, 1000])
def test_join_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(op4, "BUCKET_BLOCK", block)
    monkeypatch.setattr(op4, "GROUP_BLOCK", block)
    rows = make_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", op4.F.lit("clash"))
    got = op4.memberships(df).select("doc_id", "class_id", "n_links").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)[0]


def test_blocks_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(op4, "GROUP_BYTES", 2_000)
    rows = make_texts()
    got = op4.memberships(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)[0]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_members_of_one_id_meet_their_own_texts(spark, monkeypatch, doc_id):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(40)]
    met = spark.sparkContext.accumulator(0)
    make = op4._regrammer

    def counted():
        run = make()

        def count(texts):
            met.add(len(texts))
            return run(texts)

        return count

    monkeypatch.setattr(op4, "_regrammer", counted)
    got = op4.memberships(spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got) == brute([(doc_id, t) for t in texts])[0]
    assert met.value == len(texts)


CLASHES = ["keep", "score", "n_items", "_n", "_items", "_id", "_hash", "_v", "at", "row", "key", "hash", "task", "lang_pred", "p_text", "words", "a.b"]


def test_one_of_each(spark, moved):
    rows = make_texts()
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(rows)], schema)
    kept = []
    # Neither texts nor rows travel.
    assert not moved(lambda: kept.extend(op4.one_of_each(df).collect())) & {"text", "row", *CLASHES} - {"key", "at", "hash", "task"}
    _, classes, sets = brute(rows)
    with_words = [v for v in classes.values() if sets[v[0]]]
    want = [min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for v in with_words] + [None, 1001, 1002]
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, want))
    assert all(tuple(r) in {(*x, *[f"{c}{i}" for c in CLASHES]) for i, x in enumerate(rows)} for r in kept) and kept[0].__fields__ == df.columns
    assert op4.one_of_each(df.limit(0)).collect() == [] and op4.memberships(df.limit(0)).collect() == []


def test_likeness_at_the_threshold():
    a = np.arange(90, dtype=np.uint64)
    assert op4.linked([a, np.arange(10, 100, dtype=np.uint64)])[0, 1]  # 80 of 100
    assert not op4.linked([a, np.arange(11, 101, dtype=np.uint64)])[0, 1]
    many = [np.arange(i, i + 90, dtype=np.uint64) for i in range(12)]
    few = np.array([[i != j and abs(i - j) <= 10 for j in range(12)] for i in range(12)])
    assert (op4.linked(many) == few).all()
    assert (op4.linked(many[:5], b=many[5:]) == few[:5, 5:]).all() and (op4.linked(many[:1], b=many[1:]) == few[:1, 1:]).all()


def test_pruning_keeps_what_can_reach_the_threshold():
    least = op4.least_agreeing()
    assert all(x <= 0.8 * n for x, n in zip(least, range(16, 129, 16), strict=True)) and list(least) == sorted(least)
    rng = np.random.default_rng(1)
    s = rng.integers(0, 256, (2, op4.VALUES)).astype(np.uint8)
    assert len(op4.prune(s, np.array([0]), np.array([1]), least)) == 0
    s[1, : int(0.8 * op4.VALUES)] = s[0, : int(0.8 * op4.VALUES)]
    assert len(op4.prune(s, np.array([0]), np.array([1]), least)) == 1


def test_pairs_that_meet_in_any_bucket_are_linked():
    rng = np.random.default_rng(5)
    n = 20_000
    u = rng.integers(0, 2**63, (n, op4.VALUES), np.uint64)
    v = np.where(rng.random((n, op4.VALUES)) < rng.uniform(0.8, 0.95, (n, 1)), u, rng.integers(0, 2**63, u.shape, np.uint64))
    rows, want = [], set()
    for k, pair in enumerate(zip(u, v, strict=True)):
        keys = [k.to_bytes(4) + bytes([side]) for side in (0, 1)]
        sigs, bands = [op4.short(x) for x in pair], [op4.band_keys(x) for x in pair]
        for place in np.nonzero(bands[0] == bands[1])[0]:
            rows += [(int(bands[0][place]), 0, 0, 0, key, sig) for key, sig in zip(keys, sigs, strict=True)]
        if (bands[0] == bands[1]).any() and len(op4.prune(np.stack([np.frombuffer(x, np.uint8) for x in sigs]), np.array([0]), np.array([1]), op4.least_agreeing())):
            want.add(tuple(keys))
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["band", "i", "j", "side", "key", "sig"])]
    got = {tuple(sorted(e)) for b in op4.candidate_edges(iter(batches)) for e in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    assert len(want) > 0.99 * n and got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 199)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in chain], "u binary, v binary")
    got = {r.node[0]: r.root[0] for r in components(df, "u", "v").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 199: 199, 200: 199}
    assert components(df.limit(0), "u", "v").collect() == []
