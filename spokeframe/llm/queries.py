"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocknames, bpe, centroids, fim, htmltext, jpeg, langid, minhash, mixing, sharding, tokencount, urlfilter, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.read_media(jpeg.store_texts(table(spark, sf_dir, "documents")))


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.find_copies(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_bpe,
        op3_url_filter,
        op4_minhash_near_dedup,
        op5_language_id,
        op6_jpeg,
        op7_jump_sharding,
        op8_token_counts,
        op9_pareto_mixing,
        op10_block_naming,
        op11_html_text,
        op12_centroids,
        op13_fill_in_middle,
    )
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_url_filter": urlfilter.ORACLE_SQL,
    "op7_jump_sharding": sharding.ORACLE_SQL,
    "op9_pareto_mixing": mixing.ORACLE_SQL,
    "op10_block_naming": blocknames.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
