"""Queries of the training-text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.protocol import with_role
from ..sources.tables import table
from .cross_split import overlap_pairs, overlap_report
from .encode import corpus_ids, with_token_counts
from .format_copies import copy_counts, format_copies
from .leakage import leak_report, leaked_items
from .lookalikes import lookalike_pairs
from .mixing import mixture, mixture_shares
from .near_duplicates import near_duplicates
from .spam import page_curves, spam_pages


def _stories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tinystories", "story_id", "text")


def _split_stories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tinystories", "story_id", "source", "hub_split", "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_stories(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(_stories(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_copies(_stories(spark, folder))


def p3_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copy_counts(_stories(spark, folder))


def _leak_texts(spark: SparkSession, folder: str) -> DataFrame:
    train = with_role(_split_stories(spark, folder), table(spark, folder, "data_integrity")).where("role = 'train'")
    stories = train.select(F.lit("tinystories").alias("record_table"), F.col("story_id").alias("record_id"), "text")
    records = table(spark, folder, "memorization_records", "record_id", "nearest_training_example")
    return stories.union(records.select(F.lit("memorization_records").alias("record_table"), "record_id", F.col("nearest_training_example").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(_leak_texts(spark, folder), table(spark, folder, "heldout_items"))


def p4_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(p4_found(spark, folder), table(spark, folder, "heldout_items"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_pairs(_split_stories(spark, folder), table(spark, folder, "data_integrity"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(_split_stories(spark, folder), table(spark, folder, "data_integrity"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_ids(table(spark, folder, "documents", "doc_id", "text"))


def p6_tokens_by_source(spark: SparkSession, folder: str) -> DataFrame:
    counts = with_token_counts(table(spark, folder, "documents", "source", "text"))
    return counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_shares(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(table(spark, folder, "documents", "doc_id", "text", "lang"))


def p8_curves(spark: SparkSession, folder: str) -> DataFrame:
    return page_curves(table(spark, folder, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p3_copy_counts, p4_found, p4_leaked_items, p5_found, p5_report, p6_ids, p6_tokens_by_source)
    return {f.__name__: f for f in (*found, p7_mixture, p7_shares, p8_found, p8_curves)}


def oracle_sql() -> dict[str, str]:
    return {}
