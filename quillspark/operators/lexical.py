"""Lexical diversity and repetition of generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, repeated_fraction, sentences, words


def measures(records: DataFrame, text_col: str = "completion") -> DataFrame:
    """records with words and, for each text, the share of repeated 4-grams and of repeated sentences."""
    spoken = sentences(F.col(text_col))
    loops = F.when(F.size("_sentences") >= 2, repeated_fraction(F.col("_sentences"))).otherwise(F.lit(0.0))
    return (
        records.where(F.col(text_col).isNotNull())
        .withColumn("_words", words(F.col(text_col)))
        .withColumn("_sentences", spoken)
        .withColumn("_grams", ngrams(F.col("_words"), 4))
        .withColumn("repeated_4gram", repeated_fraction(F.col("_grams")))
        .withColumn("sentence_repetition", loops)
        .drop("_sentences", "_grams")
    )


def distinct_ratios(rows: DataFrame, by: list[Column], ns: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per group: distinct n-grams over all n-grams of its texts, 0 if it has none. Grams are counted before the
    distinct count, so a frequent gram is one row for each task."""
    names = [f"_k{i}" for i in range(len(by))]
    keys = [k.alias(n) for k, n in zip(by, names)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), ngrams(F.col("_words"), n).alias("grams")) for n in ns)))
    grams = rows.select(*keys, each.alias("e")).select(*names, "e.n", F.explode("e.grams").alias("gram")).groupBy(*names, "n", "gram").agg(F.count("*").alias("c"))
    ratio = lambda n: F.coalesce(F.count_if(F.col("n") == n) / F.nullif(F.sum(F.when(F.col("n") == n, F.col("c"))), F.lit(0)), F.lit(0.0))
    return grams.groupBy(*names).agg(*(F.round(ratio(n), 9).alias(f"distinct_{n}") for n in ns))


def lexical_summary(records: DataFrame, by: dict[str, Column], text_col: str = "completion") -> DataFrame:
    """Per group of by (name to column): generations, mean words and new tokens, rate of finished texts, distinct-1 and
    -2 over the group, means of repeated 4-grams and sentences. Keys are strings, "None" for null; no records give no
    rows."""
    text = {name: F.coalesce(column.cast("string"), F.lit("None")) for name, column in by.items()}
    rows = measures(records, text_col)
    means = rows.groupBy(*(c.alias(n) for n, c in text.items())).agg(
        F.count("*").alias("generations"),
        F.round(F.avg(F.size("_words")), 6).alias("mean_words"),
        F.round(F.avg("new_tokens"), 6).alias("mean_new_tokens"),
        F.round(F.avg(F.col("finished_with_eos").cast("double")), 6).alias("eos_rate"),
        F.round(F.avg("repeated_4gram"), 6).alias("repeated_4gram_fraction"),
        F.round(F.avg("sentence_repetition"), 6).alias("sentence_repetition_ratio"),
    )
    ratios = distinct_ratios(rows, list(text.values()))
    for i, name in enumerate(text):
        ratios = ratios.withColumnRenamed(f"_k{i}", name)
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return means.join(ratios, list(text), "left").select(*text, "generations", "mean_words", "mean_new_tokens", "eos_rate", none("distinct_1"), none("distinct_2"), "repeated_4gram_fraction", "sentence_repetition_ratio")
