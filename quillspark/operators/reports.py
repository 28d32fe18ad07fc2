"""Projections for tables and charts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import unit_histogram_bin
from ..functions.text import slug


def item_id(*parts: str) -> Column:
    return F.concat_ws("|", *(F.col(p).cast("string") for p in parts))


# The criteria of a rating sheet.
CRITERIA = ("grammar", "coherence", "creativity", "consistency", "plot")


def rating_sheet(generations: DataFrame) -> DataFrame:
    """One row for each generation with empty columns for ratings."""
    return generations.select(item_id("prompt_id", "preset", "seed").alias("item_id"), "category", "prompt", "completion", *(F.lit("").alias(c) for c in CRITERIA))


def judge_prompt(prompt: Column, continuation: Column, criteria: tuple[str, ...] = CRITERIA) -> Column:
    head = "Rate the continuation from 1 to 10 for: " + ", ".join(criteria) + "."
    return F.concat(F.lit(head + "\n\nPrompt: "), prompt, F.lit("\n\nContinuation: "), continuation)


def parse_judgement(answer: Column) -> Column:
    """MAP<criterion, STRUCT<score, justification>> of a judge's JSON answer; null if it is not JSON."""
    return F.from_json(answer, "map<string, struct<score: double, justification: string>>")


def rubric_summary(judged: DataFrame) -> DataFrame:
    """(criterion, mean, std, n) over rows (item_id, scores MAP<STRING, DOUBLE>); one score has deviation 0; rows
    without scores don't count."""
    scored = judged.where(F.size(F.map_keys("scores")) > 0).select(F.explode("scores").alias("criterion", "score"))
    return scored.groupBy("criterion").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"), F.count("score").alias("n"))


def histogram(rows: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """(by, bin, count, density) of values in [0, 1]."""
    binned = rows.where(F.col(value).isNotNull()).select(by, unit_histogram_bin(F.col(value), bins).alias("bin")).where("bin is not null")
    counts = binned.groupBy(by, "bin").agg(F.count("*").alias("count"))
    total = binned.groupBy(by).agg(F.count("*").alias("total"))
    return counts.join(total, by).select(by, "bin", "count", F.round(F.col("count") * bins / F.col("total"), 6).alias("density"))


def chart_points(history: DataFrame, every: int = 100) -> DataFrame:
    """Training curve for charts: every `every`-th step and all steps before it, values rounded to four digits."""
    return history.where("kind = 'train'").where((F.col("step") % every == 0) | (F.col("step") < every)).select("run_id", "step", F.round("train_loss", 4).alias("train_loss"), F.round("lr", 8).alias("lr"))


def hardware_slug(name: Column) -> Column:
    return slug(name)


# Parts that a short hardware name leaves out.
HARDWARE_NOISE = ("NVIDIA ", "GeForce ", "(R)", "(TM)", "11th Gen ", "Intel ", "Core ")


def short_hardware(name: Column) -> Column:
    """A hardware name for a chart's axis: without HARDWARE_NOISE, of a processor in brackets only what stands before its
    clock rate or further details, single blanks."""
    # one after another: a mark may stand inside another part
    plain = functools.reduce(lambda text, part: F.replace(text, F.lit(part), F.lit("")), HARDWARE_NOISE, name)
    inside = F.trim(F.regexp_extract(plain, r"^CPU \(([^,@]*)", 1))
    return F.trim(F.regexp_replace(F.when(plain.startswith("CPU ("), F.concat(F.lit("CPU "), inside)).otherwise(plain), r"\s+", " "))


def write_rating_sheet(generations: DataFrame, path: str) -> None:
    """rating_sheet as CSV files with a header in a folder; quotes are doubled, so texts may hold any character."""
    rating_sheet(generations).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def generation_rates(rows: DataFrame, new_tokens: str, first: str, total: str) -> DataFrame:
    """rows with decode_per_second, of the tokens after the first in the time after the first, and end_to_end_per_second."""
    after = F.greatest(F.col(total) - F.col(first), F.lit(1e-9))
    return rows.withColumn("decode_per_second", F.round((F.col(new_tokens) - 1) / after, 6)).withColumn("end_to_end_per_second", F.round(F.col(new_tokens) / F.nullif(F.col(total), F.lit(0.0)), 6))


def speed_ratios(rows: DataFrame, by: list[str], name: str, value: str, base: str) -> DataFrame:
    """(by, name, median, ratio): the median of each name in its group and its ratio to that of `base` in the same group."""
    middle = rows.where(F.col(value).isNotNull()).groupBy(*by, name).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    other = middle.where(F.col(name) == base).select(*by, F.nullif(F.col("median"), F.lit(0.0)).alias("base"))
    return middle.join(other, by, "left").select(*by, name, F.round("median", 6).alias("median"), F.round(F.col("median") / F.col("base"), 6).alias("ratio"))


def most_per_group(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.max(value), 6).alias("most"))


def timing_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one value) and median of repeated measurements."""
    used = rows.where(F.col(value).isNotNull())
    return used.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, for a report."""
    return rows.orderBy(*order).limit(n)


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a bounded report; null is a dash."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.select(*columns).toLocalIterator():
        lines.append("| " + " | ".join("—" if v is None else f"{v:,.2f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)
