"""From raw documents to encoded training text: quality, exact and near duplicates, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet into the session's shared folder and read back as the next
stage's ``docs``. All stages but the last return the columns of the documents.

Cases of nulls, empty and long texts, ties and extra columns are those of the
operators; a stage on an empty table returns an empty table. In the mixed
table a document stands as often as it is drawn, so its row repeats; the last
stage returns one row per row that it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locflow.llm import bpe, exact_dedup, mixing, near_text, quality
from locflow.llm.shared import table, written

TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; learnt from the labelled ones that are not held out."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8 or more)."""
    return near_text.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per drawn document: token count, digest of its ids and of the text they decode to."""
    import public_tokenizers
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good_quality), ("exact_dedup", one_of_equal), ("near_dedup", one_of_near), ("mix", mixed),
          ("bpe", encoded)]

#: The classifier, the near-duplicate search and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the encoded rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
