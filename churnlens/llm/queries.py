"""The numbered queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import alignment, conversations, langid, media, mixing, neighbours, packing, pii, quality_model, rules, sharding, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_digests(_table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op9_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(_table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit_repairs(_table(spark, folder, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_quality_classifier, op3_source_mixing, op4_media_columns, op5_language_id, op6_toxicity, op7_pii_spans, op8_sharding, op9_harmonic_packing, op10_quality_rules, op11_token_alignment, op12_nearest_neighbours, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op3_source_mixing": mixing.SQL, "op10_quality_rules": rules.SQL}
