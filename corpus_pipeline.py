"""From raw documents to token ids: stages that each read what the one before has written.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is the table that the
stage before left, and returns the rows it leaves. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeframe.llm import blocknames, bpe, langid, minhash, mixing
from spokeframe.llm.common import materialise, ready, table

#: Percent of the union of two documents' shingles from which on they are near-duplicates.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or between languages, go. Rows are judged alone: repeated ones and those without an id like any other; long texts whole."""
    ready(spark)
    return langid.keep_rows(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays; of null and empty texts one, of rows alike one, of a group without ids one."""
    ready(spark)
    return blocknames.keep_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays. Texts without words are in no group and stay, as do rows without an id that have no near-duplicate."""
    ready(spark)
    return minhash.keep_rows(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as many times as the mix of sources takes it, whole; one without words not for certain. Rows without an id draw as the empty string does."""
    ready(spark)
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every copy; a null text has no ids. An empty table gives, as in every stage, an empty result."""
    ready(spark)
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("BPE", encode),
]

#: Compression, MinHash and BPE have no form in SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
