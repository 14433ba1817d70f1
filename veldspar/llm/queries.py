"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, chat, decontaminate, fingerprint, langid, mixing, sharding, simhash, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.recurring_runs(_table(spark, sf_dir, "documents"))


def op2_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_tokens(_table(spark, sf_dir, "documents"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_chats(_table(spark, sf_dir, "conversations"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "slot", "shard", "map_version")


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(_table(spark, sf_dir, "documents"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_bitpack, op3_chat_repair, op4_virtual_slots, op5_warc_zstd, op6_multiset_hash,
        op7_simhash_golay, op8_language_id, op9_decontaminate, op10_source_mixing, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_virtual_slots": sharding.SHARDED_SQL,
    "op5_warc_zstd": warc.PAGES_SQL,
    "op6_multiset_hash": fingerprint.FINGERPRINTS_SQL,
}
