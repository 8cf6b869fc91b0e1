"""The index feed: pending documents to payloads, near duplicates suppressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INDEX_BATCH, INDEX_CONTENT_CHARS
from .neardup import first_duplicates

#: Which columns the index searches, filters by and shows.
SETTINGS = {"searchable": ("title", "description", "content"), "filterable": ("lang",), "displayed": ("id", "url", "title", "description", "lang"), "ranking": ("words", "typo", "proximity", "attribute", "exactness")}


def pending(documents: DataFrame, batch: int = INDEX_BATCH, id_col: str = "url_id") -> DataFrame:
    """The pending documents that have waited longest."""
    return documents.filter("index_state = 'pending'").orderBy("updated_at", id_col).limit(batch)


def payload(documents: DataFrame, id_col: str = "url_id", text_col: str = "text") -> DataFrame:
    """What the index gets of a document: all columns but the text, which becomes `content`, cut to its bound."""
    return documents.select(*[c for c in documents.columns if c != text_col], F.substring(text_col, 1, INDEX_CONTENT_CHARS).alias("content"))


def drain(documents: DataFrame, now: Column, id_col: str = "url_id", indexed: DataFrame | None = None) -> DataFrame:
    """documents with index_state, duplicate_of and indexed_at after the feed has taken all of them."""
    found = first_duplicates(documents, id_col, indexed=indexed)
    out = documents.drop("duplicate_of", "index_state", "indexed_at").join(found, id_col, "left")
    return out.withColumns({"index_state": F.when(F.col("duplicate_of").isNull(), "indexed").otherwise("suppressed"), "indexed_at": now})


def mark(documents: DataFrame, ids: DataFrame, state: str, now: Column, id_col: str = "url_id") -> DataFrame:
    """documents with a state for those in ids; an empty ids changes nothing."""
    hit = ids.select(id_col).distinct().withColumn("_hit", F.lit(True))
    out = documents.join(hit, id_col, "left")
    put = {"index_state": F.lit(state)} | ({"indexed_at": now} if state != "failed" else {})
    return out.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in put.items()}).drop("_hit")


def retry_failed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("index_state", F.when(F.col("index_state") == "failed", "pending").otherwise(F.col("index_state")))


def tokens(documents: DataFrame, id_col: str = "url_id", text_col: str = "content") -> DataFrame:
    """token, id, n: an inverted index of payloads."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return documents.select(F.col(id_col), F.explode(words).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("n"))
