"""The pipeline's stages on a small table, the queries' SQL, and the driver contract."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_sql_agrees(spark):
    from spindrift.llm import registry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in registry.ORACLE_SQL.items():
        got, want = registry.QUERIES[name](spark, DATA), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        order = sorted(got.columns)
        rows = lambda cols, found: sorted(repr([r[cols.index(c)] for c in order]) for r in found)
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name


@needs_data
def test_stages(spark):
    import corpus_pipeline as p
    from spindrift.llm import op1_quality, op4_ngram_join, op7_decontamination, op8_language
    from spindrift.llm.common import cut, table

    docs = table(spark, DATA, "documents")
    columns = docs.columns
    steps = [docs]
    for k, (name, stage) in enumerate(p.STAGES):
        out = cut(stage(spark, steps[-1], DATA), name)
        if k < len(p.STAGES) - 1:
            assert out.columns == columns
            assert out.exceptAll(steps[-1]).count() == 0
        steps.append(out)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    kept = {r.doc_id for r in op1_quality.classify(docs, table(spark, DATA, "labels")).filter("keep").collect()}
    assert ids[1] == kept
    classes = op4_ngram_join.memberships(steps[2]).collect()
    assert ids[3] == {r.class_id for r in classes}
    net = op8_language.fit(steps[1].filter(op8_language.remainder() != 2))
    told = op8_language.predict(steps[1], net).filter((op8_language.F.col("lang_pred") != "und") & (op8_language.F.col("score") >= op8_language.least_score(len(net.languages))))
    assert ids[2] == {r.doc_id for r in told.collect()}
    bench = {r.item_id: r.text for r in table(spark, DATA, "benchmark").collect()}
    windows = set().union(*[op7_decontamination.item_windows(op7_decontamination.normal_words(t)) for t in bench.values()])
    clean = {r.doc_id for r in steps[3].collect() if not (windows & op7_decontamination.item_windows(op7_decontamination.normal_words(r.text)))}
    assert ids[4] == clean and ids[5] == clean
    assert steps[-1].filter('not round_trip').count() == 0


CLASHES = ["keep", "score", "n_items", "_n", "_items", "_id", "_hash", "_v", "at", "row", "key", "hash", "task", "lang_pred", "p_text", "words", "hits", "items", "a.b"]


@needs_data
def test_stages_take_any_table(spark):
    import corpus_pipeline as p
    from spindrift.llm.common import F, table

    docs = table(spark, DATA, "documents")
    odd = [(None, None, None, None, None), (None, "", "en", "src1", 0), (7_000_001, None, "en", None, None), (7_000_002, "", None, "src1", 0), (7_000_003, "?! 123", "de", "src1", 6)]
    odd += [(7_000_004, "long words here " * 30_000, "en", "src1", 0)] * 2 + [(7_000_005, "of the house and the river with trees", "en", "src1", 37)] * 3
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *[F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHES])
    given = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and {(r.doc_id, r.text) for r in rows} <= given, name
        assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES), name
        copies = [sum(r.doc_id == i for r in rows) for i in (7_000_004, 7_000_005)]
        assert copies == [1, 1] if name == "near_copies" else all(a in (0, b) for a, b in zip(copies, (2, 3), strict=True)), name
        ids = {r.doc_id for r in rows}
        if name == "language":
            assert not ids & {None, 7_000_001, 7_000_002, 7_000_003}
        if name in ("near_copies", "decontamination"):
            assert {None, 7_000_001, 7_000_002, 7_000_003} <= ids
        assert stage(spark, docs.limit(0), DATA).collect() == [], name
    out = p.encoding(spark, docs, DATA).collect()
    assert len(out) == docs.count() and all(r.round_trip and (r.n_pieces == 0) == (r.ids == []) for r in out)
    assert p.encoding(spark, docs.limit(0), DATA).collect() == []


@needs_data
def test_run_leaves_its_result_alone(spark):
    import corpus_pipeline as p
    from spindrift.sources.scratch import made

    before = set(made())
    out = p.run(spark, DATA)
    assert len(set(made()) - before) == 1 and out.count() > 0


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil

    # With the two folders gone alone, and with the pipeline gone as well.
    for with_pipeline in (True, False):
        folder = tmp_path / str(with_pipeline)
        folder.mkdir()
        for name in ("spindrift", "__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
            src = ROOT / name
            shutil.copytree(src, folder / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, folder / name)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, env={**os.environ, "PYTHONPATH": str(folder)})


def test_near_copies_finds_isolated_pairs(spark):
    import random

    import corpus_pipeline as p
    from spindrift.llm import op4_ngram_join as op4

    rng, grams, rows, want = random.Random(9), op4.Grams(), [], set()
    for k in range(4_000):
        words = [f"{rng.getrandbits(32):x}" for _ in range(60)]
        other = list(words)
        other[rng.randrange(5, 55)] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = (set(grams(" ".join(w)).tolist()) for w in (words, other))
        want |= {2 * k} if len(a & b) >= 0.8 * len(a | b) else {2 * k, 2 * k + 1}
    kept = p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(want) == 4_000 and {r.doc_id for r in kept} == want
