"""A corpus from raw documents to token ids, a stage at a time.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder, reads them again for the next, and
then removes what the stage has read and made for itself.

Every stage takes tables of any size, none included (an empty result), texts of any length and columns of any names
beside its own: these are returned as they came. What a stage does with nulls, empty texts, ties and repeated rows is
said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import op1_quality, op4_ngram_join, op7_decontamination, op8_language, op10_sentencepiece
from spindrift.llm.common import table
from spindrift.sources.scratch import discard, made, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as texts without words; null sources and languages are groups of their own; repeated
    rows count, and go or stay, alike.
    """
    return op1_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, lift: float = op8_language.LIFT) -> DataFrame:
    """Documents without a letter, or of no language that the network can tell, go.

    Null and empty texts have no letter. A score counts from `lift` of the way from chance to certainty on. Repeated rows
    go or stay alike; where no text has a label there is no language to tell, and all go.
    """
    net = op8_language.fit(docs.filter(op8_language.remainder() != 2))
    return op8_language.keep_known(docs, net, lift=lift)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays: the one with the smallest id, null ids last.

    Null texts and those without words are copies of nothing and stay, repeated rows of such once.
    """
    return op4_ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go.

    Null and empty texts hold none and stay; items that are null or without words have none; repeated rows go or stay alike.
    """
    return op7_decontamination.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, whether they read back as its text, and that reading's digest. Null texts have no ids."""
    return op10_sentencepiece.encode_texts(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = set(made())
        docs, path = written(stage(spark, docs, sf_dir), name)
        discard([p for p in made() if p not in before and p != path] + read)
        read = [path]
    return docs
