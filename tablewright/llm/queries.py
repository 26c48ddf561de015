"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan, line_dedup, media_avi, mixing, packing, quality_rules, secret_scan, simhash, toxicity, wavelet_store
from .common import documents, labels


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet_store.write_shards(documents(spark, sf_dir), vocabulary(), end_id=0)
    return wavelet_store.read_shards(shards)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_digest(documents(spark, sf_dir))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_schedule(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), report=True).select("doc_id", "text", "n_lines", "n_dropped")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_wavelet_tokens": op2_wavelet_tokens,
        "op3_secret_scan": op3_secret_scan,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_avi_media": op7_avi_media,
        "op8_temperature_mixing": op8_temperature_mixing,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle_sql(), "op8_temperature_mixing": mixing.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL}
