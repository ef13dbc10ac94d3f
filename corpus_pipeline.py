"""From raw documents to token ids: language, near copies, the mix of sources, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents. Of an empty table every
stage makes an empty one; extra columns may have any names and hold nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, mixing, queries, simhash
from tidemark.llm.runtime import fresh_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language the network can tell.

    Null and empty texts have no letter and go; rows without a doc_id or a lang
    stay if their text is in a known language; repeated rows are judged alike.
    """
    net, langs = language.fit(docs)
    return language.keep(docs, net, langs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group.

    Of rows that repeat this doc_id one stays, any of them; rows without a
    doc_id stay; null and empty texts are near-duplicates of one another.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants; those it doesn't want go.

    Null and empty texts give nothing and go; rows without a source are one
    source; rows without a doc_id are taken like others; rows of one id and
    size share evenly what they give.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row per document taken, as often as it was taken.

    A null text is the empty one, with the end id alone; a null doc_id stays null.
    """
    return queries.op4_sentencepiece(spark, sf_dir, docs)


STAGES = [("language ID", known_language), ("SimHash near-dedup", without_near_copies), ("mixing sources", mixed), ("SentencePiece", encoded)]

#: The language network has no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := fresh_path(spark, "stage"))
            docs = spark.read.parquet(path)
    return docs
