"""The corpus pipeline: documents in, the training mixture out. Counted as part of subpackage llm.

Every stage takes documents of any number, null ids, languages, sources and texts, empty and very long texts, repeated
rows, empty tables and other columns of any name; what each does with them is in its docstring and its operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, kneser_ney, mixing, paragraphs, simhash, storage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model doesn't reject.

    Rows with a null or empty text, a null language, or one without two trusted documents stay. Repeated rows are each
    judged; equal texts of a language alike. Without labels all stay. An empty table gives an empty one.
    """
    storage.give_back(spark)
    return kneser_ney.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Rows with a null doc_id, a null text or a text without words are in no group and stay. Rows that repeat a doc_id are
    one document and stay or go together. An empty table gives an empty one.
    """
    storage.give_back(spark)
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; n_chars follows the text where it was cut.

    No row goes: a text of which nothing is left is empty. Null texts stay null. Rows with a null doc_id stay as they
    are. Repeated rows lose the same. Rows of one doc_id with different texts are different documents. An empty table gives an empty one.
    """
    storage.give_back(spark)
    return paragraphs.without_repeats(docs, natural=True, length="n_chars")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all without a benchmark. Repeated rows stay or go together. An empty table gives an empty one.
    """
    storage.give_back(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns and texts, that the target weights take, by nested budgets.

    Rows with a null doc_id have no hash and go. A null source is a source of its own and is taken whole, as are tiny ones.
    Null texts have no tokens and stay if their hash is under their source's threshold. Repeated rows stay or go together. An
    empty table gives an empty one.
    """
    storage.give_back(spark)
    return mixing.keep_mixed(docs, least=0.25)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor wrote; the rows are the texts to train on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = storage.keep(stage(spark, docs, sf_dir), name), docs
        # Only tables that were kept here are dropped, never the input.
        storage.drop(before)
    return docs


#: Training a model and searching for near copies have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
