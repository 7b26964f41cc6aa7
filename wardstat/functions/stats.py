"""Aggregate expressions: confidence intervals, proportions, quartiles, shares."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wardstat.functions.temporal import as_column

Z_95 = 1.96


class Interval(NamedTuple):
    estimate: Column
    lower: Column
    upper: Column


def mean_ci(value: Column | str, n: Column | None = None, z: float = Z_95) -> Interval:
    """Mean with a normal interval ``z * s / sqrt(n)``.

    ``n`` defaults to the number of non-NULL values; pass another count to divide by that.
    The bounds are NULL for a single row, where the sample deviation is undefined.
    """
    value = as_column(value)
    n = F.count(value) if n is None else n
    mean = F.avg(value)
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.nullif(n, F.lit(0)).cast("double"))
    return Interval(mean, mean - half, mean + half)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def proportion_ci(hits: Column, n: Column, z: float = Z_95, ci_scale: float = 100.0) -> Interval:
    """Percentage ``100 * hits / n`` with a Wald interval.

    ``ci_scale=1`` leaves the half width on the 0-1 scale while the estimate is a percentage.
    """
    total = F.nullif(n, F.lit(0)).cast("double")
    share = hits.cast("double") / total
    half = F.lit(z) * F.sqrt(share * (1.0 - share) / total) * ci_scale
    percent = share * 100.0
    return Interval(percent, percent - half, percent + half)


def quartiles(value: Column | str) -> Column:
    """Exact interpolated quartiles ``[q1, median, q3]`` as an array.

    Spark keeps one entry per distinct value and group, so this suits counts and scores with
    few distinct values; for continuous columns use ``operators.ordered.exact_quantiles``.
    """
    return F.percentile(as_column(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def share_of_total(count: Column | str, *within: str) -> Column:
    """Percentage of the column total; use on an already grouped (small) frame."""
    count = as_column(count).cast("double")
    return count * 100.0 / F.sum(count).over(Window.partitionBy(*within))
