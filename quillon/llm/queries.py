"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import attention_lm, decontaminate, html_density, kneser_ney, language_id, mixing, paragraphs, simhash, suffix_index, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a lossless WebP image, decoded to its pixel array."""
    return webp.decode_images(webp.gray_images(_table(spark, sf_dir, "embeddings"))).select("vec_id", "width", "height", "pixels", "error")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), least=0.25)


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(_table(spark, sf_dir, "pages"))


def op4_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.long_matches(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return kneser_ney.train(docs, _table(spark, sf_dir, "labels")).scored(docs)


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(_table(spark, sf_dir, "documents"), natural=True)


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scores(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_webp, op2_mixing, op3_html_density, op4_suffix_index, op5_quality, op6_paragraphs, op7_attention_lm, op8_simhash, op9_decontamination, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_webp": webp.gray_sql(), "op2_mixing": mixing.mix_sql()}
