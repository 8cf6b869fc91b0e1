"""Language identification with a byte convolutional network.

Texts are cut into windows of WINDOW bytes of UTF-8, which cover them whole; the last one is padded. Each byte is a
learned vector; filters of several widths slide over the window, each keeps its largest value, and a softmax layer turns
these into probabilities. A text's are the means over its windows, weighted by their bytes. Training is plain numpy
(Adam on cross-entropy) on a bounded sample: MOST_DOCUMENTS divided among all labelled languages, at most PER_LANGUAGE and
at least one of each, chosen by a hash of id and text, and PER_DOCUMENT windows of each, from places spread over the text.
Every labelled language is learned. The weights are a few kB and go to every task.

Prediction reads the text alone. Documents whose crc32 of the id modulo 4 is 2 are held out of training (see op8).

Defined results: a text that is null or has no letter is `und` with score 0; with no labelled text at all every text is
`und`; repeated rows are predicted alike and learned once; input columns named as outputs are replaced, others may have any
names; keep_known() returns all as they came. Null labels are never learned. Of languages that are equally likely the
first by name is told.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, name, packed, table

WINDOW = 256
WIDTHS = (2, 3, 5)
FILTERS = 24
VECTOR = 8
#: Bounds of the training sample, and its use.
PER_LANGUAGE = 400
PER_DOCUMENT = 3
MOST_DOCUMENTS = 25_600
EPOCHS = 8
BATCH = 64
SEED = 7

UNKNOWN = "und"
#: How far from chance to certainty a score must be for keep_known(): 0.3 with four languages.
LIFT = 1 / 15
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def cut_windows(data: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows x size bytes as classes 1..256, 0 for padding; bytes in each window)."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    weights = np.full(n, size, np.float32)
    weights[-1] = len(data) - (n - 1) * size
    return out.reshape(n, size), weights


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # 257 x VECTOR; padding's stays 0
    filters: list[np.ndarray]  # for each width: width * VECTOR x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.filters, self.bias, self.dense, self.dense_bias]

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Largest value of each filter in each window (after bias and ReLU), where it is, and the windows' vectors."""
        x = self.vectors[windows]
        n, length, v = x.shape
        flat = x.reshape(n, length * v)
        tops, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            seen = np.lib.stride_tricks.as_strided(flat, (n, length - w + 1, w * v), (flat.strides[0], v * flat.strides[1], flat.strides[1]))
            y = (seen.reshape(-1, w * v) @ f).reshape(n, length - w + 1, -1)
            at = y.argmax(1)
            places.append(at)
            tops.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0, :])
        return np.maximum(np.concatenate(tops, 1) + self.bias, 0), places, flat

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = self.vectors[windows]
        n, length, v = x.shape
        flat = x.reshape(n, length * v)
        tops = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            seen = np.lib.stride_tricks.as_strided(flat, (n, length - w + 1, w * v), (flat.strides[0], v * flat.strides[1], flat.strides[1]))
            tops.append((seen.reshape(-1, w * v) @ f).reshape(n, length - w + 1, -1).max(1))
        return _softmax(np.maximum(np.concatenate(tops, 1) + self.bias, 0) @ self.dense + self.dense_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network from windows and their languages' numbers."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, draw(257, VECTOR, scale=0.5), [draw(w * VECTOR, FILTERS, scale=(2 / (w * VECTOR)) ** 0.5) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), draw(FILTERS * len(WIDTHS), len(languages), scale=0.1), np.zeros(len(languages), np.float32))
    net.vectors[0] = 0
    mean, var, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            step += 1
            for k, (p, g) in enumerate(zip(net.parameters(), _gradients(net, windows[rows], labels[rows]), strict=True)):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                p -= 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
            net.vectors[0] = 0
    return net


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    h, places, flat = net.features(windows)
    n = len(windows)
    dz = _softmax(h @ net.dense + net.dense_bias)
    dz[np.arange(n), labels] -= 1
    dz /= n
    dh = (dz @ net.dense.T) * (h > 0)
    dvec = np.zeros_like(net.vectors)
    dfilters = []
    for k, (w, f, at) in enumerate(zip(WIDTHS, net.filters, places, strict=True)):
        g = dh[:, k * FILTERS : (k + 1) * FILTERS]
        # The part of the window under each filter's largest value: n x FILTERS x (w * VECTOR).
        under = at[:, :, None] * VECTOR + np.arange(w * VECTOR)
        seen = np.take_along_axis(flat[:, None, :], under, 2)
        dfilters.append(np.einsum("nf,nfk->kf", g, seen))
        back = (g[:, :, None] * f.T[None]).reshape(n, -1, w, VECTOR)
        bytes_under = np.take_along_axis(windows[:, None, :].astype(np.int64), at[:, :, None] + np.arange(w), 2)
        np.add.at(dvec, bytes_under.ravel(), back.reshape(-1, VECTOR))
    return [dvec, *dfilters, dh.sum(0), h.T @ dz, dz.sum(0)]


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Windows of at most per_language documents of each language, as (language, bytes), in a fixed order.

    Languages are counted first; a document is drawn if a hash of it is under its language's share, so no language gathers
    in one task, and repeated rows are one before anything reaches the driver: about 1.5 * per_language documents a
    language at most. A language of which nothing was drawn gives its first by hash.
    """
    rows = labelled.select(name(lang_col).alias("l"), F.xxhash64(name(id_col), name(text_col)).alias("h"), name(text_col).alias("t")).filter("l is not null and t is not null")
    counts = rows.groupBy("l").count().collect()
    if not counts:
        return []
    whole = 1 << 62
    per_language = max(1, min(per_language, MOST_DOCUMENTS // len(counts)))
    shares = [(lang, min(whole, int(1.5 * per_language / n * whole) + 1)) for lang, n in counts]
    shares = F.broadcast(labelled.sparkSession.createDataFrame(shares, "l string, share long"))
    spots = F.transform(F.sequence(F.lit(0), F.lit(PER_DOCUMENT - 1)), lambda i: F.substring("t", (F.length("t") * i / PER_DOCUMENT).cast("int") + 1, F.lit(WINDOW)))
    shown = ["l", "h", F.array_distinct(spots).alias("s")]
    under = F.col("h").bitwiseAND(F.lit(whole - 1)) < F.col("share")
    drawn = rows.join(shares, "l").filter(under).select(*shown).groupBy("l", "h").agg(F.min("s").alias("s")).collect()
    missing = {lang for lang, _ in counts} - {r[0] for r in drawn}
    if missing:
        left = F.broadcast(labelled.sparkSession.createDataFrame([(lang,) for lang in missing], "l string"))
        first = rows.join(left, "l", "left_semi").select(*shown).filter("size(array_remove(s, '')) > 0")
        drawn += first.groupBy("l").agg(F.min(F.struct("h", "s")).alias("f")).select("l", "f.*").collect()
    out, taken = [], {}
    for lang, _, parts in sorted(drawn, key=lambda r: (r[0], r[1], r[2])):
        if taken.get(lang, 0) < per_language:
            taken[lang] = taken.get(lang, 0) + 1
            out += [(lang, p.encode()[:WINDOW]) for p in parts if p]
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    drawn = sample(labelled, id_col, text_col, lang_col)
    if not drawn:
        return None
    languages = sorted({lang for lang, _ in drawn})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.concatenate([cut_windows(data)[0] for _, data in drawn])
    return train(windows, np.array([number[lang] for lang, _ in drawn]), languages)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predictor(spark: SparkSession, net: Network | None) -> Callable[[], Callable[[pa.Array], list]]:
    held = spark.sparkContext.broadcast(net)

    def make() -> Callable[[pa.Array], list]:
        net = held.value

        def run(texts: pa.Array) -> list:
            texts = texts.to_pylist()
            known = [i for i, t in enumerate(texts) if t and net is not None and has_letter(t)]
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            sums = np.zeros((len(texts), len(net.languages) if net else 1))
            # Windows of several texts go through the network together, a bounded number at a time.
            rows, owners, weights, held_rows = [], [], [], 0

            def flush() -> None:
                if rows:
                    p = net.probabilities(np.concatenate(rows)) * np.concatenate(weights)[:, None]
                    np.add.at(sums, np.concatenate(owners), p)
                    rows.clear(), owners.clear(), weights.clear()

            for i in known:
                w, n = cut_windows(texts[i].encode())
                for k in range(0, len(w), 128):
                    rows.append(w[k : k + 128])
                    weights.append(n[k : k + 128])
                    owners.append(np.full(len(rows[-1]), i))
                    held_rows += len(rows[-1])
                    if held_rows >= 128:
                        flush()
                        held_rows = 0
            flush()
            for i in known:
                p = sums[i] / sums[i].sum()
                best = int(p.argmax())
                out[i] = (net.languages[best], min(1.0, float(p[best])))
            return [list(c) for c in zip(*out, strict=True)] if out else [[], []]

        return run

    return make


def predict(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score of its text column, from all windows of each text."""
    return append(df, [text_col], FIELDS, _predictor(df.sparkSession, net))


def least_score(n: int, lift: float = LIFT) -> float:
    """The score that stands `lift` of the way from chance among n languages to certainty."""
    return 1 / n + lift * (1 - 1 / n) - 1e-6 if n else 0.0


def keep_known(df: DataFrame, net: Network | None, text_col: str = "text", lift: float = LIFT) -> DataFrame:
    """df's rows whose text has a letter and a language that the network can tell."""
    told = append(packed(df), [("row", text_col)], FIELDS, _predictor(df.sparkSession, net))
    least = least_score(len(net.languages) if net else 0, lift)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.filter(remainder() != 2).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), net).drop("text")
    return out.withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))
