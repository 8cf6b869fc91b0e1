"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import xxhash

from spindrift.llm import op1_quality as op1
from spindrift.llm import op2_fingerprints as op2
from spindrift.llm import op3_warc as op3
from spindrift.llm import op5_token_counts as op5
from spindrift.llm import op6_chat_formatting as op6
from spindrift.llm import op7_decontamination as op7
from spindrift.llm import op8_language as op8
from spindrift.llm import op9_url_filters as op9
from spindrift.llm import op10_sentencepiece as op10
from spindrift.llm import pieces
from spindrift.llm.common import Files, append, attach, cut, hot_join, numbered, scratch

LONG = "word " * 20_000 + "end"
TEXTS = [(1, "the quick brown fox. " * 5), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "no id é 日本"), (7, "the quick brown fox. " * 5), (8, "a\n\n  b\t▁ c ")]
DOCS = "doc_id long, text string"
#: Columns of a table that an operator may use names of itself.
CLASHES = ["keep", "score", "n_items", "_n", "_items", "_id", "_hash", "_v", "at", "row", "key", "task", "host", "path", "p_text", "words", "a.b"]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, DOCS)


# 1 quality classifier


def quality_tables(spark, n=300):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice(["the", "river", "walks", "over", "stone", "garden"]) for _ in range(60)]
        text = " ".join(words).capitalize() + "." if good else " ".join(f"{w}$$$ ###" for w in words)
        rows.append((i, text, "en" if i % 3 else "fr", "hot" if i % 3 else f"h{i % 7}"))
        if i % 2 == 0:
            labels.append((i, int(good)))
    rows += [(None, None, None, None), (1000, "", "en", "new"), (0, rows[0][1], "fr", "h0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_separates_and_matches_brute_force(spark):
    d, labels = quality_tables(spark)
    got = op1.classify(d, labels).collect()
    assert len(got) == d.count()
    good = [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.keep == (r.doc_id % 4 != 0) for r in good]) > 0.98
    n, s = len(got), sum(r.p_text for r in got)
    mean = s / n / 1e6
    hosts, paths = {}, {}
    for r in got:
        for t, k in ((hosts, r.host), (paths, (r.host, r.path))):
            a, b = t.get(k, (0, 0))
            t[k] = (a + 1, b + r.p_text / 1e6)

    def strength(groups):
        big = [(a, b, m) for a, b, m in groups if a >= 2]
        spread = sum((b / a - m) ** 2 for a, b, m in big)
        chance = sum(m * (1 - m) / a for a, b, m in big)
        most = sum(m * (1 - m) for a, b, m in big)
        share = max(0, spread - chance) / most
        return min(1000, max(1, 1 / share - 1 if share else 1000))

    kh = strength([(a, b, mean) for a, b in hosts.values()])
    kp = strength([(a, b, (hosts[h][1] + kh * mean) / (hosts[h][0] + kh)) for (h, _), (a, b) in paths.items()])
    logit = lambda p: np.log(p / (1 - p))
    for r in got:
        p = r.p_text / 1e6
        ph = (hosts[r.host][1] - p + kh * mean) / (hosts[r.host][0] - 1 + kh)
        pp = (paths[r.host, r.path][1] - p + kp * ph) / (paths[r.host, r.path][0] - 1 + kp)
        post = 1 / (1 + np.exp(-(logit(p) + op1.TRUST * (logit(pp) - logit(mean)))))
        assert r.posterior == pytest.approx(post, abs=1e-4)


def test_quality_without_labels_or_rows(spark):
    d, labels = quality_tables(spark, 20)
    got = op1.classify(d, labels.limit(0)).collect()
    assert len(got) == 23 and all(r.p_text == 500_000 for r in got)
    assert op1.classify(d.limit(0), labels).collect() == [] and op1.keep_good(d.limit(0), labels).collect() == []


def test_quality_keeps_columns_of_any_name(spark):
    d, labels = quality_tables(spark)
    want = {repr(r.doc_id) for r in op1.classify(d, labels).filter("keep").collect()}
    clashing = d.select("*", *[op1.F.concat(op1.F.lit(f"{c} "), op1.F.coalesce("doc_id", op1.F.lit(-1))).alias(c) for c in CLASHES])
    got = op1.keep_good(clashing, labels)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert {repr(r.doc_id) for r in rows} == want
    assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)


def test_quality_moves_no_texts_with_many_hosts(spark, moved):
    d, labels = quality_tables(spark, 6000)
    d = d.withColumn("source", op1.F.concat(op1.F.lit("h"), op1.F.col("doc_id") % 5000))
    assert not moved(lambda: op1.keep_good(d, labels).write.format("noop").mode("overwrite").save()) & {"text", "row"}


def test_quality_of_long_tied_and_repeated_texts(spark):
    d, labels = quality_tables(spark, 60)
    extra = spark.createDataFrame([(5000, LONG, "en", "hot"), (5001, LONG, "en", "hot"), (5001, LONG, "en", "hot")], d.schema)
    ids = spark.createDataFrame([(0, 1)] * 50, "doc_id long, quality int")  # labels repeated as well
    got = [r for r in op1.classify(d.unionByName(extra), labels.unionByName(ids)).collect() if r.doc_id and r.doc_id >= 5000]
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1


# 2 fingerprints


def text_hash(text):
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprints(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), r[1]), reverse=True)
    prints = [op2.fingerprint(t) for _, t in order]
    out = []
    for k, (i, t) in enumerate(order):
        n = (k + 1) % len(order)
        edited = t[: len(t) - len(t) // 2] + order[n][1][: len(t) // 2]
        e = op2.fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), op2.as_text(prints[k]), op2.as_text(e), op2.likeness(prints[k], e), op2.likeness(prints[k], prints[n])))
    return sorted(map(repr, out))


@pytest.mark.parametrize("range_rows", [2, 3, 1000])
def test_fingerprints_match_brute_force(spark, range_rows):
    rng = random.Random(range_rows)
    rows = TEXTS + [(i, "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 200)))) for i in range(20, 60)]
    got = op2.fingerprint_pairs(docs(spark, rows), range_rows=range_rows).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_fingerprints(rows)


def test_fingerprints_few_rows(spark):
    assert op2.fingerprint_pairs(docs(spark, [])).collect() == []
    (one,) = op2.fingerprint_pairs(docs(spark, [(5, "abcabc")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_phrases_are_those_of_the_parse():
    ends, known = [], set()
    op2.parse("aababcabc", known, "", ends)
    assert known == {"a", "ab", "abc"} and ends == [1, 3, 6]
    text = "aababcab"
    ends, known = [], set()
    op2.parse(text, known, "", ends)
    h = op2.phrase_hashes(text, ends)
    alone = [op2.phrase_hashes(p, [len(p)])[0] for p in ("a", "ab", "abc", "ab")]
    assert h.tolist() == [int(x) for x in alone]


def test_fingerprints_of_ids_that_many_rows_share(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 else i % 2, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = docs(spark, rows).select("*", *[op1.F.lit(1).alias(c) for c in CLASHES])
    parts = op2.with_neighbour_rows(df, "doc_id", "text", 20).filter("not extra").groupBy("part").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) <= 60  # a null id is cut as well
    assert sorted(repr(tuple(r)) for r in op2.fingerprint_pairs(df, range_rows=20).collect()) == brute_fingerprints(rows)


def test_likeness_is_that_of_the_phrase_sets():
    def phrases(text):
        known, start = set(), 0
        for i in range(1, len(text) + 1):
            if text[start:i] not in known:
                known.add(text[start:i])
                start = i
        return known | ({text[start:]} - {""})

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    for share in (0.0, 0.3, 0.7, 0.95, 1.0):
        near = []
        for _ in range(20):
            a = " ".join(rng.choice(words) for _ in range(400))
            b = a[: int(share * len(a))] + " ".join(rng.choice(words) for _ in range(400))[int(share * len(a)) :]
            x, y = phrases(a), phrases(b)
            near.append(op2.likeness(op2.fingerprint(a), op2.fingerprint(b)) - len(x & y) / len(x | y))
        assert abs(np.mean(near)) < 0.03 and np.max(np.abs(near)) < 0.2


# 3 WARC


def test_warc_round_trip(spark):
    pages = [(3, "http://B.com/x?q=1#f", "same"), (1, "https://www.a.com", "same"), (2, None, None), (5, "http://b.com/x?q=1", "other\r\n\r\né"), (5, "http://b.com/x?q=1", "other\r\n\r\né"), (9, "bad\r\nurl", ""), (None, "http://c/", "same"), (None, "http://d/", "alone"), (6, "http://b.com/" + "p" * 5000, LONG)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = scratch(spark, "test-warc")
    runs, n = op3.write_archives(df, folder, range_rows=2)
    merged = op3.merge_runs(runs, folder, n)
    order = [(r.range, r.place, (r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0)) for r in merged.collect()]
    assert [k for *_, k in sorted(order, key=lambda r: r[:2])] == sorted(k for *_, k in order) and len(order) == len(pages)
    got = op3.read_archives(merged, folder).collect()
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = least.get(h or "")
        want.append((i, len(data), op3.payload_digest(data), "response" if first in (i, None) else "revisit", None if first == i else first))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(map(repr, want))


def test_warc_small_payloads_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string")
    folder = scratch(spark, "test-warc")
    runs, n = op3.write_archives(df, folder, min_bytes=2)
    assert {r.record_type for r in op3.read_archives(op3.merge_runs(runs, folder, n), folder).collect()} == {"response"}
    runs, n = op3.write_archives(df.limit(0), folder)
    assert op3.read_archives(op3.merge_runs(runs, folder, n), folder).collect() == []


def warc_rows(pages):
    """What the archives of pages (page_id, url, html) are to give."""
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in pages:
        data, first = (h or "").encode(), least.get(h or "")
        out.append((i, len(data), op3.payload_digest(data), "response" if first in (i, None) else "revisit", None if first == i else first))
    return sorted(map(repr, out))


def test_warc_references_on_both_sides_of_the_hot_limit(spark, moved):
    rng = random.Random(3)
    # One payload has half of all pages, 1,500 have two to four copies each, the others none.
    html = ["hot"] * 4000 + [f"copy {rng.randrange(1500)}" for _ in range(3500)] + [f"alone {i}" for i in range(500)]
    rng.shuffle(html)
    pages = [(i, f"http://h{i % 700}.org/{i}", h) for i, h in enumerate(html)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("*", *[op1.F.lit(1).alias(c) for c in CLASHES]).repartition(3)
    found = []

    def run():
        folder = scratch(spark, "test-warc")
        runs, n = op3.write_archives(df, folder, range_rows=1000)
        found.extend(op3.read_archives(op3.cut(op3.merge_runs(runs, folder, n), "captures"), folder).collect())

    df = op3.cut(df, "pages")
    assert not moved(run) & {"html", "row"}
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found) == warc_rows(pages)


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = [sorted((rng.randint(0, 9), j) for j in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(op3.loser_tree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(op3.loser_tree([])) == []


def test_more_runs_than_one_merge_reads(spark, monkeypatch):
    monkeypatch.setattr(op3, "FAN_IN", 3)
    pages = [(i, f"http://h{i * 7 % 50}.org/{i % 3}", f"page {i}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(11)
    folder = scratch(spark, "test-warc")
    runs, n = op3.write_archives(df, folder, range_rows=150)
    assert runs.select("run").distinct().count() > op3.FAN_IN
    rows = sorted((r.range, r.place, r.url_key, r.captured_at, r.page_id) for r in op3.merge_runs(runs, folder, n).collect())
    assert [r[2:] for r in rows] == sorted((op3.url_key(u), op3._stamp(i), i) for i, u, _ in pages)


def test_short_runs_are_told(tmp_path):
    files = Files(str(tmp_path))
    files.write("a.run", [op3._line(("k", "t", 1, "f", 0, 5))])
    size = len((tmp_path / "a.run").read_bytes())
    assert len(list(op3._read_slice(files, "a.run", 0, size))) == 1
    with pytest.raises(ValueError):
        list(op3._read_slice(files, "a.run", 0, size + 9))


# 5 token counts, 10 encoding


def library():
    return sentencepiece.SentencePieceProcessor(model_file=op5.model_path())


HARD = ["", " ", "\n", "\n\n a", "  a  b ", "▁x▁▁y", "a\n b", "<s> hi </s><unk>", "日本語 テスト\t\tx", "   \n   ", "x" * 3000, " " * 100 + "z", "é\r\nb", LONG]


def test_counts_and_ids_are_the_librarys(spark):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(" \n▁aéthe日<s>\t") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    sp = library()
    pieces = [sp.id_to_piece(i) for i in range(300, 32_000)]
    texts += ["".join(rng.choice(pieces).replace("▁", rng.choice(["", " "])) for _ in range(60)) for _ in range(300)]
    want = sp.encode(texts, num_threads=1)
    assert op5.counter(op5.model_path())(texts) == list(map(len, want))
    codec = op10.Codec(op5.model_path())
    ids = [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)]
    assert ids == want
    assert all(codec.decode(i) == t.replace("▁", " ") for i, t in zip(ids, texts, strict=True))


def test_counts_and_ids_on_rows(spark):
    df = docs(spark).withColumn("n_tokens", op1.F.lit("clash"))
    got = op5.count_tokens(df).collect()
    sp = library()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got) == sorted(repr((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096)) for i, t in TEXTS)
    enc = op10.encode_texts(df).collect()
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in enc)
    assert all(r.ids == sp.encode(r.text or "") and r.n_pieces == len(r.ids) for r in enc)
    assert op5.count_tokens(docs(spark, [])).collect() == [] and op10.encode_texts(docs(spark, [])).collect() == []


def test_spaces_are_cut_as_the_library_does():
    texts = [f"{' ' * n}{w}{' ' * m}" for n in range(70) for w in ("", "the", "日", "\n", "x") for m in (0, 1, 2, 15, 17, 31)]
    codec, sp = op10.Codec(op5.model_path()), library()
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)] == sp.encode(texts, num_threads=1)
    assert op5.counter(op5.model_path())(texts) == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_window_stays_small():
    rng = random.Random(7)
    sp, lattice = library(), op10.Lattice(op10.Pieces(op5.model_path()))
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    for text in (letters, "th" * 50_000, "\u0bf5" * 100_000, "日x\u0bf5" * 30_000, " " * 50_000 + letters[:50_000]):
        assert lattice.encode("▁" + text.replace(" ", "▁")).tolist() == sp.encode(text)
    assert lattice.widest < 1024


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 2_000)
    kept = pieces.Cache({"a": 1}, lambda new: [len(w) for w in new])
    for k in range(300):
        words = ["a", f"w{k}", f"w{k % 3}", "long" * 30]
        assert kept.look_up([words, words[:1]]) == [[1, len(words[1]), 2, 120], [1]]
        assert kept.held < 3_000 and len(kept.kept) < 20 and "long" * 30 not in kept.kept


# 6 chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "<\\|", "<|", "|>", "\\", "<n|", "<\\n|", "assistant", "a"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    for role, text in zip(mixed[:300], mixed[300:], strict=True):
        chunk, start, length = op6.format_turn(role, text)
        assert op6.parse(chunk) == [(role, text)] and op6.unescape(chunk[start : start + length]) == text
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate([("user", mixed[0]), ("assistant", mixed[1]), (None, None), ("assistant", "")])] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "assistant", LONG), (2, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", op1.F.lit(1))
    got = {r.conv_id: r for r in op6.read_back(op6.format_turns(df)).collect()}
    for conv in (1, 2, None):
        turns = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        said = [x for _, _, r, x in turns if r == "assistant"]
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len("".join(said))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[conv].formatted_chars == sum(len(op6.format_turn(r, x)[0]) for _, _, r, x in turns)
    assert op6.read_back(op6.format_turns(df.limit(0))).collect() == []


# 7 decontamination


def test_decontamination(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota."
    bench = spark.createDataFrame([(1, item), (2, "one two three"), (2, "one two three"), (None, "x"), (3, None), (4, "..."), (10, item)], "item_id long, text string")
    rows = [(1, "pre ALPHA-beta gamma\ndelta epsilon zeta eta theta post"), (2, None), (3, ""), (4, "one two three " * 3), (5, "zone two three; éone two three"), (6, "clean"), (6, "clean"), (7, f"é {item} one two three " + LONG)]
    df = docs(spark, rows).withColumn("n_items", op1.F.lit("clash"))
    for most in (op7.MOST_WINDOWS, 1):
        got = sorted(op7.decontaminate(df, bench, most=most).collect(), key=lambda r: r.doc_id)
        by = {r.doc_id: r for r in got}
        assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 6, 7]
        assert (by[1].n_words, by[1].n_hit, sorted(by[1].item_ids), by[1].contaminated) == (10, 8, [1, 10], True)
        assert by[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest() and by[2].items_sha256 == hashlib.sha256(b"").hexdigest()
        assert [rows[0][1][s.start : s.end] for s in by[1].spans] == ["ALPHA-beta gamma\ndelta epsilon zeta eta theta"]
        assert (by[4].n_hit, by[4].n_items, by[5].n_hit, by[2].n_words) == (9, 1, 0, 0)
        assert (by[7].n_items, by[7].n_hit) == (3, 12) and by[7].items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
        assert [rows[-1][1][s.start : s.end] for s in by[7].spans] == ["Alpha beta, gamma delta epsilon zeta eta theta iota. one two three"]
    assert op7.decontaminate(df.limit(0), bench).collect() == []
    clashing = docs(spark, rows).select("*", *[op1.F.lit(c).alias(c) for c in [*CLASHES, "hits", "items"]])
    kept = op7.clean(clashing, bench)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 6]
    assert all(r[c] == c for r in kept.collect() for c in CLASHES) and op7.clean(clashing.limit(0), bench).collect() == []
    out = op7.decontaminate(clashing, bench, spans=False)
    assert len(out.columns) == len(set(out.columns)) and all(r["_items"] == "_items" and r.spans is None for r in out.collect())
    assert {r.n_items for r in op7.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_spans_of_many_hits_take_linear_time():
    import time

    text = "é one two three, " * 100_000
    hits = [i for i in range(400_000) if i % 4]
    start = time.perf_counter()
    spans = op7.original_spans(text, hits)
    assert time.perf_counter() - start < 5 and len(spans) == 100_000
    assert {text[a:b] for a, b in spans} == {"one two three"}


# 8 language


def language_rows():
    rng = random.Random(5)
    bank = {"en": "the of and thing with over".split(), "de": "der und nicht schön über ist".split(), "fr": "le la être où que déjà".split()}
    return [(i, " ".join(rng.choice(bank[lang]) for _ in range(rng.randint(5, 120))), lang) for i in range(240) for lang in [list(bank)[i % 3]]]


def test_language_held_out(spark):
    df = spark.createDataFrame([*language_rows(), (900, None, "en"), (901, "123 !?", "de"), (None, "the and of", None), (902, LONG, "en")], "doc_id long, text string, lang string").withColumn("score", op1.F.lit("clash"))
    net = op8.fit(df.filter(op8.remainder() != 2))
    got = op8.predict(df, net).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert op8.predict(df.limit(0), net).collect() == [] and op8.fit(df.filter("lang is null")) is None
    assert {r.lang_pred for r in op8.predict(df, None).collect()} == {"und"}


def test_forward_pass_is_that_of_the_definition():
    rng = np.random.default_rng(4)
    net = op8.train(rng.integers(1, 257, (8, 40)).astype(np.int16), np.arange(8) % 3, ["a", "b", "c"], epochs=1)
    windows = rng.integers(0, 257, (4, 40)).astype(np.int16)
    for row, got in zip(windows, net.probabilities(windows), strict=True):
        tops = []
        for width, filters in zip(op8.WIDTHS, net.filters, strict=True):
            for f in range(op8.FILTERS):
                weights = filters[:, f].reshape(width, op8.VECTOR)
                tops.append(max(sum(float(net.vectors[row[i + k]] @ weights[k]) for k in range(width)) for i in range(40 - width + 1)))
        h = np.maximum(np.array(tops) + net.bias, 0)
        z = h @ net.dense + net.dense_bias
        assert got == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), rel=1e-4)
    assert op8.cut_windows(b"ab" * 300)[0].shape == (3, op8.WINDOW) and op8.cut_windows(b"ab" * 300)[1].tolist() == [256, 256, 88]


def test_score_is_the_mean_over_windows(spark):
    net = op8.train(np.random.default_rng(1).integers(1, 257, (12, op8.WINDOW)).astype(np.int16), np.arange(12) % 3, ["a", "b", "c"], epochs=2)
    text = "some words that fill more windows than one, " * 30
    w, n = op8.cut_windows(text.encode())
    want = (net.probabilities(w) * n[:, None]).sum(0) / n.sum()
    got = op8.predict(docs(spark, [(1, text), (1, text), (2, text[:100])]), net).collect()
    assert [r.score for r in got[:2]] == pytest.approx([want.max()] * 2, rel=1e-5) and got[0].lang_pred == "abc"[want.argmax()]


def test_many_languages_are_learned_and_told(spark):
    rng = random.Random(11)
    banks = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçßøå", 6)) for _ in range(70)]
    rows = [(k * 20 + i, " ".join("".join(rng.choice(banks[k]) for _ in range(5)) for _ in range(40)), f"l{k:02}") for k in range(70) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = op8.fit(df.filter(op8.remainder() != 2))
    assert len(net.languages) == 70
    held = [r for r in op8.predict(df.filter(op8.remainder() == 2), net).collect()]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.8


def test_repeated_rows_do_not_fill_the_sample(spark):
    rows = [(1, "the one text", "en")] * 5000 + [(i, f"der text {i}", "de") for i in range(2, 12)]
    drawn = op8.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert 0 < sum(lang == "en" for lang, _ in drawn) <= op8.PER_DOCUMENT and {lang for lang, _ in drawn} == {"en", "de"}


def test_known_languages_are_kept_with_all_columns(spark):
    df = spark.createDataFrame([*language_rows(), (900, None, "en"), (901, "123 !?", "de"), (902, "", "fr")], "doc_id long, text string, lang string")
    net = op8.fit(df)
    clashing = df.select("*", *[op1.F.lit(c).alias(c) for c in CLASHES])
    kept = op8.keep_known(clashing, net)
    told = {r.doc_id for r in op8.predict(df, net).collect() if r.lang_pred != "und" and r.score >= 1 / 3 + op8.LIFT * 2 / 3}
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == told and not told & {900, 901, 902}
    assert all(r[c] == c for r in kept.collect() for c in CLASHES)
    assert op8.keep_known(df, None).collect() == [] and op8.least_score(4) == pytest.approx(0.3, abs=1e-5)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w, y = rng.integers(1, 257, (6, 32)).astype(np.int16), np.array([0, 1, 2, 0, 1, 2])
    net = op8.train(w, y, ["a", "b", "c"], epochs=1)
    net = op8.Network(net.languages, *[x.astype(np.float64) if isinstance(x, np.ndarray) else [f.astype(np.float64) for f in x] for x in (net.vectors, net.filters, net.bias, net.dense, net.dense_bias)])
    loss = lambda: -np.log(net.probabilities(w)[np.arange(6), y]).mean()
    for p, g in zip(net.parameters(), op8._gradients(net, w, y), strict=True):
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in p.shape)
            old, eps = p[i], 1e-6
            p[i] = old + eps
            up = loss()
            p[i] = old - eps
            down = loss()
            p[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[i], abs=1e-4)


# 9 URL filters


def test_url_filter(spark):
    rows = [("http://WWW.Example.com/en/x", "www.example.com/en/", "allow"), ("http://a.example.com/en/", "example.com/en/", "block"), ("https://x.net/es/1?a#b", "net/es/", "block"), ("https://x.net/de/1", None, "allow"), ("http://com", None, "allow"), ("http://q.com/porn", "com/", "allow"), ("http://q.org/porn", None, "block"), ("http://q.org/pornish", None, "allow"), ("http://q.org/casino?casino", None, "allow"), ("http://q.org/casino-poker", None, "block"), (None, None, "allow"), ("", None, "allow"), ("no scheme/XXX/", None, "block"), ("http://notnet/es/", None, "allow"), ("http://a.org?x/net/es/", None, "allow")]
    rows += [("http://casino-win.org/", None, "block"), ("http://m.adult-x.org/en/1", None, "block"), ("http://q.org/%70orn", None, "block"), ("http://q.org/win/bonus", None, "allow"), ("http://q.org/win/bonus/x", None, "block"), ("http://q.org/éporn", None, "allow"), ("http://q.org/%zz" + "a/" * 20_000 + "erotik_gratis", None, "block"), ("http://q.org/casino-poker", None, "block")]
    df = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, rule string").select("*", *[op1.F.lit(c).alias(c) for c in CLASHES if c not in ("host", "path")])
    got = sorted(op9.filter_urls(df).collect())
    assert [(r.url, r.rule, r.verdict) for r in got] == rows and all(r[c] == c for r in got for c in ("keep", "_v", "at"))
    assert (got[2].host, got[2].path) == ("x.net", "/es/1") and (got[4].host, got[4].path) == ("com", "") and (got[14].host, got[14].path) == ("a.org", "")
    assert (got[15].strict_hits, got[15].soft_hits, got[15].soft_weight) == (0, 2, 2.5)
    assert op9.filter_urls(df.limit(0)).collect() == []


def test_url_vocabulary(spark, tmp_path):
    known = op9.vocabulary()
    assert 300 < len(known) == len({t.text for t in known}) and all(t.weight < op9.LIMIT for t in known if not t.strict)
    own = spark.createDataFrame([("Spam", True, None), ("ham", False, 2.0), ("ham", False, 2.5), ("eggs", False, None), (None, True, 1.0), (" ", True, 1.0)], "term string, strict boolean, weight double")
    own.write.parquet(str(tmp_path / "terms"))
    df = spark.createDataFrame([(1, "http://a/spam"), (2, "http://a/ham"), (3, "http://a/ham/eggs"), (4, "http://a/porn")], "page_id long, url string")
    for terms in (own, str(tmp_path / "terms"), op9.read_terms(own)):
        assert [r.verdict for r in sorted(op9.filter_urls(df, terms=terms).collect())] == ["block", "allow", "block", "allow"]
    with pytest.raises(ValueError):
        op9.read_terms(own, most=3)
    assert {r.verdict for r in op9.filter_urls(df, terms=()).collect()} == {"allow"}


# joins on hot keys


def test_hot_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(3000)], "i long, k string")
    right = left.groupBy("k").agg(op1.F.count("*").alias("n")).filter("k is null or k <> 'k6'")
    got = {(r.i, r.k, r.n) for r in hot_join(left, right, ["k"], "n", share=10).collect()}
    n = {r.k: r.n for r in right.collect()}
    assert got == {(r.i, r.k, n.get(r.k)) for r in left.collect()}


def test_hot_join_with_any_names(spark):
    left = spark.createDataFrame([(i, i % 4, i % 2) for i in range(50)], "row long, k long, v long")
    right = left.groupBy("k").agg(op1.F.count("*").alias("n"), op1.F.max("row").alias("r0"))
    got = hot_join(left, right, ["k"], "n", share=3)
    assert got.columns == ["row", "k", "v", "n", "r0"]
    most = {r.k: (r.n, r.r0) for r in right.collect()}
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 4, i % 2, *most[i % 4]) for i in range(50)]


def test_attach_finds_rows_where_they_lie(spark, moved):
    table = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "task long, text string").repartition(7)
    held = cut(numbered(table), "held")
    side = held.filter("row.task % 3 = 0").select("at", op1.F.col("row.task").alias("x"), op1.F.when(op1.F.col("row.task") % 2 == 0, op1.F.array("at")).alias("y"))
    got = []
    assert not moved(lambda: got.extend(attach(held, side).collect())) & {"row", "text"}
    assert len(got) == 1000 and all((r.x, r.y) == ((r.row.task, None if r.row.task % 2 else [r.at]) if r.row.task % 3 == 0 else (None, None)) for r in got)
    assert sorted(r.row.task for r in attach(held, side.select("at"), only=True).collect()) == list(range(0, 1000, 3))
    assert attach(held, side.limit(0), only=True).collect() == [] and attach(held.limit(0), side).collect() == []


def test_append_with_any_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "`a.b` long, `te``xt` string")
    got = append(df, ["te`xt"], [op1.T.StructField("A.B", op1.T.LongType())], lambda: lambda t: [[len(x or "") for x in t.to_pylist()]])
    assert got.columns == ["te`xt", "A.B"] and {tuple(r) for r in got.collect()} == {("a", 1), (None, 0)}


def test_workers_return_memory_after_a_task(spark):
    def make():
        import os
        import sys

        held = [bytes(1000) for _ in range(300_000)]
        sys.spindrift_last = bytes(1000)  # above the others, so that the C library cannot shrink its heap by itself
        return lambda ids: [[os.getpid() if held else 0] * len(ids)]

    df = spark.range(0, 8, 1, 1)
    pids = {r.pid for r in append(df, ["id"], [op1.T.StructField("pid", op1.T.LongType())], make).collect()}
    for pid in pids:
        with open(f"/proc/{pid}/smaps_rollup") as f:
            anon = sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024
        assert anon < 250, anon


def test_every_labelled_language_is_sampled(spark, monkeypatch):
    rows = [(k * 100 + i, f"text {i} of language {k}", f"l{k:03}") for k in range(70) for i in range(3 if k else 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {f"l{k:03}" for k in range(70)}
    assert {lang for lang, _ in op8.sample(df, "doc_id", "text", "lang")} == want
    monkeypatch.setattr(op8, "MOST_DOCUMENTS", 10, raising=False)
    few = op8.sample(df, "doc_id", "text", "lang")
    assert {lang for lang, _ in few} == want and len(few) <= 70 * op8.PER_DOCUMENT
