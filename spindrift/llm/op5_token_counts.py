"""Token counts with a whole-token shortcut.

Once in each task the vocabulary's own strings are encoded alone; those that come back as one token are proven whole
tokens. Texts are cut where no piece can span (see pieces.py), parts that are proven whole count one without any
merging, and only the others go through the library's merges, each different one once a slice and, if it is short, then
kept in a cache bounded in bytes. A text's count is the sum over its parts, which is exact because nothing merges across a cut.

One row in, one row out, no shuffle. Whole texts of any length are counted. Defined results: a null text counts as
empty (0 bytes, 0 tokens); repeated rows are counted alike; input columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append, table
from .pieces import SPACE, Cache, Pieces, words

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_tokens(pieces: Pieces) -> dict[str, int]:
    """The parts of words() that stand for a vocabulary string which the library encodes alone as one token: each counts 1."""
    parts = [p[1:] if p[0] == SPACE and p[1:2] != SPACE else p for p in pieces.normal if p[0] == SPACE and p != SPACE]
    whole = {p: 1 for p, ids in zip(parts, pieces.alone(parts), strict=True) if len(ids) == 1}
    # `▁` and a line break are seen in the encoding of a line break, which has a `▁` before it.
    return whole | ({"": 1, "\n\n": 1} if len(pieces.library.encode("\n")) == 2 else {})


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts."""
    pieces = Pieces(path)
    kept = Cache(whole_tokens(pieces), lambda new: map(len, pieces.alone(new)))
    return lambda texts: list(map(sum, kept.look_up([words(t) for t in texts])))


def count_tokens(df: DataFrame, text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit of its text column. model: the file's path, on every executor."""

    def make() -> Callable[[pa.Array], list]:
        count = counter(model or model_path())

        def run(texts: pa.Array) -> list:
            texts = pc.fill_null(texts, "")
            n = count(texts.to_pylist())
            return [pc.binary_length(texts), n, [x > limit for x in n]]

        return run

    return append(df, [text_col], FIELDS, make, most=2 << 20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
