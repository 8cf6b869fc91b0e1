"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model in numpy, fitted on a bounded sample of labelled documents, gives each text its own evidence from the
shapes of its bytes, words and lines. A grouped aggregation gives each host and each path of a host the number of
documents and the sum of their probabilities, in whole millionths, so that the sums do not depend on order. Then:

    host mean  = (host sum + K_g * global mean) / (host documents + K_g)
    path mean  = (path sum + K_h * host mean)   / (path documents + K_h)
    logit(posterior) = logit(own) + TRUST * (logit(path mean) - logit(global mean))

A document's own probability is left out of its host's and path's sums, so that it is not counted twice. K_g and K_h are
prior strengths estimated by the method of moments from the spread of hosts around the global mean and of paths around
their hosts: the less groups differ beyond chance, the stronger sparse ones are drawn to the level above. A host or path
with no other document has the mean of the level above.

Aggregates are combined before the shuffle, so a host with a third of all documents costs one row a task. Their join
back to the documents sends keys with over a thousandth of all documents to every task, of which there are under a
thousand, and shuffles row numbers and probabilities for the others (hot_join). Texts go through the classifier once and
are never shuffled, whatever the number of hosts: the evidence is written beside the rows with a number for each, and the
rows that stay are picked where they lie (attach).

The host is a document's site (here `source`), the path a section of it (here `lang`, which is the first part of its
pages' paths); both are parameters.

Defined results: a null or empty text has the evidence of a text without any words; null hosts and paths are groups of
their own; repeated rows count as often as they occur; equal evidence has equal results in one path; with no labels, or
labels of one kind only, the classifier gives that kind's share; an empty table gives no rows; of several texts under one
labelled id, one is learned. keep_good() returns all columns as they came, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, attach, cut, hot_join, name, numbered, table

#: Most labelled documents that the classifier is fitted on.
SAMPLE = 4_000
#: How far a path's mean moves a document's own evidence.
TRUST = 0.5
#: Documents under this posterior are rejected.
THRESHOLD = 0.3
#: Bounds of the prior strengths, in documents.
STRENGTH = (1.0, 1_000.0)

_KIND = np.zeros(256, np.int64)  # 0 other control, then the kinds that a text's bytes are counted by
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=/\\", b"'\"-:;_+`", b"\t\r"), 1):
    _KIND[list(_bytes)] = _i
_KIND[128:] = 14
N_KINDS = 15

FEATURES = [*[f"kind_{i}" for i in range(N_KINDS)], "words", "word_length", "word_length_spread", "new_words", "lines", "new_lines", "line_length", "short_words", "long_words", "end_marked", "upper_words", "odd_ends"]


def features(text: str) -> np.ndarray:
    """Shares and means that tell prose from lists, markup, shouting, noise and repetition; all within a few units."""
    data = text.encode()
    n = max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=N_KINDS) / n
    ws = text.split()
    lines = [x for x in text.split("\n") if x]
    nw, nl = max(1, len(ws)), max(1, len(lines))
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    return np.array(
        [
            *(10 * kinds),
            np.log1p(len(ws)) / 5,
            len(text) / nw / 6,
            float(sizes.std()) / 4 if len(ws) else 0.0,
            len(set(ws)) / nw,
            np.log1p(len(lines)) / 4,
            len(set(lines)) / nl,
            np.log1p(len(text) / nl) / 5,
            float((sizes <= 2).sum()) / nw,
            float((sizes > 15).sum()) / nw,
            sum(map(_MARKED, lines)) / nl,
            sum(map(str.isupper, ws)) / nw,
            sum(map(_ODD, ws)) / nw,
        ],
        np.float64,
    )


def _MARKED(line: str) -> bool:  # noqa: N802
    return line[-1] in ".!?:;\"'"


def _ODD(word: str) -> bool:  # noqa: N802
    return not word[-1].isalnum() and word[-1] not in ".,;:!?\"')"


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> Classifier:
    """Logistic regression with a ridge penalty, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step / max(1.0, float(np.abs(step).max()) / 4)
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Classifier:
    """The classifier of `quality` in labels (doc_id, quality) from documents (doc_id, text), on at most `most` labels."""
    chosen = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def make() -> Callable[[pa.Array], list]:
        return lambda texts: [[features(t or "").tolist() for t in texts.to_pylist()]]

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = append(rows, ["text"], [T.StructField("x", T.ArrayType(T.DoubleType()))], make, keep=["doc_id", "quality"])
    # One row an id before anything reaches the driver, however often an id is repeated.
    found = got.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).orderBy("doc_id").select("r.*").collect()
    if not found:
        return Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    return train(np.array([r.x for r in found]), np.array([float(r.quality > 0) for r in found]))


def own_evidence(df: DataFrame, model: Classifier, text_col: str | tuple[str, str] = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or `keep` of it) with p_text, the classifier's probability in millionths (1 to 999,999), for its text column."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], list]:
        def run(texts: pa.Array) -> list:
            x = np.array([features(t or "") for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
            return [np.clip(np.rint(held.value.probability(x) * 1e6), 1, 999_999).astype(np.int64).tolist()]

        return run

    return append(df, [text_col], [T.StructField("p_text", T.LongType())], make, keep)


def strength(means: DataFrame, n: str, s: str, level: str) -> float:
    """Prior strength by the method of moments: groups of n documents with sum s around the mean of the level above.

    With p(1 - p) the largest spread that a mean p allows, the share of it by which group means differ beyond the chance
    of their sizes is 1 / (strength + 1).
    """
    one = means.filter(F.col(n) >= 2).select(
        F.sum(F.pow(F.col(s) / F.col(n) - F.col(level), 2)).alias("spread"),
        F.sum(F.col(level) * (1 - F.col(level)) / F.col(n)).alias("chance"),
        F.sum(F.col(level) * (1 - F.col(level))).alias("most"),
    )
    spread, chance, most = (float(x or 0) for x in one.first())
    share = max(0.0, spread - chance) / most if most else 0.0
    return round(min(STRENGTH[1], max(STRENGTH[0], 1 / share - 1 if share else STRENGTH[1])), 6)


def shrunk(total: Column, n: Column, above: Column, k: float) -> Column:
    return (total + F.lit(k) * above) / (n + F.lit(k))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posteriors(evidence: DataFrame, trust: float = TRUST, threshold: float = THRESHOLD) -> DataFrame:
    """evidence (host, path, p_text, and one column for a document's id or number) with p_host, p_path, posterior and keep."""
    paths = cut(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_text").alias("s")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("paths")), "hosts")
    n, s = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    if not n:
        none = F.lit(None).cast("double")
        return evidence.withColumns({"p_host": none, "p_path": none, "posterior": none, "keep": F.lit(None).cast("boolean")})
    overall = s / n / 1e6
    k_host = strength(hosts.select("hn", (F.col("hs") / 1e6).alias("hs"), F.lit(overall).alias("m")), "hn", "hs", "m")
    both = cut(hot_join(paths, hosts, ["host"], "paths").drop("paths"), "levels")
    level = both.select("n", (F.col("s") / 1e6).alias("s"), shrunk(F.col("hs") / 1e6, F.col("hn"), F.lit(overall), k_host).alias("m"))
    k_path = strength(level, "n", "s", "m")
    out = hot_join(evidence, both, ["host", "path"], "n")
    p = F.col("p_text") / 1e6
    out = out.withColumn("p_host", shrunk((F.col("hs") - F.col("p_text")) / 1e6, F.col("hn") - 1, F.lit(overall), k_host))
    out = out.withColumn("p_path", shrunk((F.col("s") - F.col("p_text")) / 1e6, F.col("n") - 1, F.col("p_host"), k_path))
    z = logit(p) + F.lit(trust) * (logit(F.col("p_path")) - logit(F.lit(overall)))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.withColumn("keep", F.col("posterior") >= threshold).drop("n", "s", "hn", "hs")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", trust: float = TRUST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host and path of every document with p_text, p_host, p_path, posterior and keep."""
    docs = docs.select(name(id_col).alias("doc_id"), name(host_col).alias("host"), name(path_col).alias("path"), name(text_col).alias("text"))
    evidence = cut(own_evidence(docs, fit(docs, labels), keep=["doc_id", "host", "path"]), "evidence")
    return posteriors(evidence, trust, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", trust: float = TRUST, threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows that the classifier keeps."""
    model = fit(docs.select(name(id_col).alias("doc_id"), name(text_col).alias("text")), labels)
    judged = cut(own_evidence(numbered(docs), model, ("row", text_col)), "judged")
    evidence = judged.select("at", name(host_col, "row").alias("host"), name(path_col, "row").alias("path"), "p_text")
    good = posteriors(evidence, trust, threshold).filter("keep").select("at")
    return attach(judged.select("at", "row"), good, only=True).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, the posteriors of its host and path, and whether it is kept."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
