"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bytebpe, html, media, milquality, minhash, mixing, negatives, packing, pii, repair, rules, sharding, toxicity
from panelcast.llm.shared import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.col("size") * F.size("draws")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return milquality.score(docs, milquality.fit(docs, table(spark, sf_dir, "labels")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 is held to, in a form that SQL can say."""
    return mixing.source_targets(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 4))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's counts of the base kinds, in a form that SQL can say."""
    return pii.personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_toxicity": op2_toxicity,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_media_columns": op5_media_columns,
        "op6_hilbert_sharding": op6_hilbert_sharding,
        "op7_quality_rules": op7_quality_rules,
        "op8_source_mixing": op8_source_mixing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_personal_data": op10_personal_data,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_conversation_repair": op13_conversation_repair,
        "mix_targets": mix_targets,
        "pii_counts": pii_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_minhash_near_dedup": minhash.ORACLE_SQL,
        "op7_quality_rules": rules.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "mix_targets": mixing.TARGETS_SQL,
        "pii_counts": pii.COUNTS_SQL,
    }
