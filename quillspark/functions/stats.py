"""Aggregates with the reference semantics of small samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: str | Column) -> Column:
    """Mean of measured values; null if none is."""
    return F.avg(value)


def seed_std(value: str | Column) -> Column:
    """Sample deviation over seeds; null for one value."""
    return F.stddev_samp(value)


def timing_std(value: str | Column) -> Column:
    """Sample deviation of timings and ratings; 0 for one value."""
    return F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def linear_percentile(value: str | Column, p: float) -> Column:
    """Percentile with linear interpolation."""
    return F.percentile(value, F.lit(p))


def unit_histogram_bin(value: Column, bins: int) -> Column:
    """Bin 1..bins of a value in [0, 1]; the right edge belongs to the last bin, values outside are null."""
    return F.when((value >= 0) & (value <= 1), F.least(F.lit(bins), F.floor(value * bins).cast("int") + 1))
