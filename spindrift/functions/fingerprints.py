"""SimHash over token shingles, and what is done with it."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SIMHASH_TOKENS

_WORD = re.compile(r"\w+")
#: Fixed value: `\w` as both engines spell it.
TOKEN = r"[\p{L}\p{N}_]+"


def simhash_of(text: str | None, n: int = SIMHASH_TOKENS) -> int | None:
    """64-bit SimHash as a signed number. A bit is set if more shingles' hashes have it than not."""
    if text is None:
        return None
    tokens = _WORD.findall(text.lower())
    if not tokens:
        return 0
    shingles = ["".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))]
    digests = b"".join(hashlib.blake2b(s.encode(), digest_size=8).digest() for s in shingles)
    votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(t) for t in text], dtype="Int64")


def simhash_md5(df: DataFrame, id_col: str, text_col: str, n: int = SIMHASH_TOKENS) -> DataFrame:
    """id, simhash with md5's first eight bytes as the shingle hash: built-in functions alone, votes combined before the shuffle.

    Ids are unique. Texts without tokens have 0.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - (n - 1), F.lit(1)))
    shingles = F.transform(starts, lambda i: F.array_join(F.slice("_t", i, n), ""))
    rows = df.select(F.col(id_col).alias("_id"), tokens.alias("_t")).select("_id", F.explode(F.when(F.size("_t") > 0, shingles).otherwise(F.array(F.lit("")))).alias("_s"))
    h = F.conv(F.substring(F.md5("_s"), 1, 16), 16, -10).cast("long")
    hashed = rows.select("_id", F.when(F.col("_s") != "", h).alias("_h"))
    # Two votes to a sum: those of bit b and, 32 bits higher, of bit b + 32.
    both = [F.sum(F.shiftright("_h", b).bitwiseAND(F.lit(1 | 1 << 32))).alias(f"_b{b}") for b in range(32)]
    votes = hashed.groupBy("_id").agg(F.count("_h").alias("_n"), *both)
    count = lambda b: F.col(f"_b{b}").bitwiseAND(F.lit((1 << 32) - 1)) if b < 32 else F.shiftright(f"_b{b - 32}", 32)
    bits = [F.when(2 * count(b) > F.col("_n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return votes.select(F.col("_id").alias(id_col), out.cast("long").alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
