"""Memorization of training text: shared spans, flags and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.stats import linear_percentile


def _renumbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of pairs, equal for equal pairs only."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1]


def longest_span(a: str, b: str) -> tuple[int, str]:
    """Length and text of the longest run of equal words; the earliest in a of several, then in b.

    Runs of equal length are numbered by their words, those of twice the length from pairs of numbers. A run that both
    texts share has shared parts, so the length is found bit by bit, from the largest power of two down."""
    left, right = a.split(), b.split()
    if not left or not right:
        return 0, ""
    number: dict[str, int] = {}
    # 0 is no word: no run across the end of a is in b
    whole = np.array([number.setdefault(w, len(number) + 1) for w in left] + [0] + [number.setdefault(w, len(number) + 1) for w in right], np.int64)
    n = len(left)

    def shared(runs: np.ndarray, length: int) -> np.ndarray:
        """Where in a runs begin that stand in b too."""
        return np.flatnonzero(np.isin(runs[: max(0, n - length + 1)], runs[n + 1 :]))

    powers = [whole]
    at = shared(whole, 1)
    if not len(at):
        return 0, ""
    while 2 ** len(powers) <= min(n, len(right)):
        half = 2 ** (len(powers) - 1)
        runs = _renumbered(powers[-1][:-half], powers[-1][half:])
        found = shared(runs, 2 * half)
        if not len(found):
            break
        powers.append(runs)
        at = found
    length, runs = 2 ** (len(powers) - 1), powers[-1]
    for k in range(len(powers) - 2, -1, -1):
        step = 2**k
        size = len(whole) - length - step + 1
        if length + step > min(n, len(right)) or size <= 0:
            continue
        longer = _renumbered(runs[:size], powers[k][length : length + size])
        found = shared(longer, length + step)
        if len(found):
            at, runs, length = found, longer, length + step
    return length, " ".join(left[at[0] : at[0] + length])


@F.arrow_udf(StructType([StructField("words", IntegerType()), StructField("span", StringType())]))
def longest_common_span(a: pa.Array, b: pa.Array) -> pa.Array:
    """Struct of words and span of the longest run of equal words of two texts; 0 and the empty text for a null one."""
    found = [(0, "") if x is None or y is None else longest_span(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], ["words", "span"])


def two_digits(value: Column) -> Column:
    """A number from 0 with two digits after the point, halves up."""
    cents = F.floor(value * 100 + F.lit(0.5)).cast("long")
    return F.concat((cents - cents % 100).cast("long").__truediv__(100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def flag_reasons(similarity: Column, verbatim: Column, span: Column, least_similarity: float = 0.8, least_ngram: int = 32, least_span: int = 30) -> Column:
    """Why a text is shown for review; an empty array if it isn't."""
    reasons = F.array(
        F.when(similarity >= least_similarity, F.concat(F.lit("similarity "), two_digits(similarity), F.lit(f" >= {least_similarity}"))),
        F.when(verbatim >= least_ngram, F.concat(F.lit("verbatim "), verbatim.cast("string"), F.lit("-token n-gram in training data"))),
        F.when(span >= least_span, F.concat(span.cast("string"), F.lit("-word span shared with nearest story"))),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def flagged(records: DataFrame) -> DataFrame:
    """records with flagged and flag_reasons computed from their measures."""
    reasons = flag_reasons(F.col("similarity"), F.col("max_matched_ngram"), F.col("longest_common_span_words"))
    return records.withColumn("flag_reasons", reasons).withColumn("flagged", F.size("flag_reasons") > 0)


def memorization_summary(records: DataFrame, ns: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """Per source: count, similarity median, p95 and maximum, mean overlaps, shares with a verbatim n-gram, spans and
    flags. Values are rounded to six digits."""
    r = lambda c: F.round(c, 6)
    overlaps = [r(F.avg(F.col("ngram_overlap")[str(n)])).alias(f"overlap_{n}_mean") for n in ns]
    verbatim = [r(F.avg((F.coalesce("max_matched_ngram", F.lit(0)) >= n).cast("double"))).alias(f"share_verbatim_{n}") for n in ns]
    return records.groupBy("source").agg(
        F.count("*").alias("count"),
        r(linear_percentile("similarity", 0.5)).alias("similarity_median"),
        r(linear_percentile("similarity", 0.95)).alias("similarity_p95"),
        r(F.max("similarity")).alias("similarity_max"),
        *overlaps,
        *verbatim,
        r(linear_percentile("longest_common_span_words", 0.5)).alias("span_words_median"),
        F.max("longest_common_span_words").alias("span_words_max"),
        F.count_if("flagged").alias("flagged"),
    )
