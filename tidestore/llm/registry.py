"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidestore.llm import ann, lattice_lm, line_dedup, media, mixing, near_dup, packing, quality, substring_dedup, toxicity
from tidestore.llm._frames import table


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_report(table(spark, sf_dir, "embeddings"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_report(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_nbsvm,
    op2_toxicity_ftrl,
    op3_minhash_near_dup,
    op4_line_dedup,
    op5_prefix_forest,
    op6_ogg_media,
    op7_curriculum_mix,
    op8_suffix_dedup,
    op9_harmonic_packing,
    op10_lattice_lm,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": line_dedup.REPORT_SQL, "op7_curriculum_mix": mixing.REPORT_SQL}
