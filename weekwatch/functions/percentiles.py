"""Order statistics over small history arrays.

A pool is the array of past values one cell is compared with. Its length is
bounded by years x window, so the expressions stay inside one row and need no
further shuffle. ``percentile()`` is not used on purpose: it interpolates in a
different order and a last-bit difference flips classes under a strict ``>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_percentile(ordered: Column, p: float) -> Column:
    """Inclusive linear percentile of an ascending array; null for an empty one."""
    n = F.size(ordered)
    position = F.lit(float(p)) * (n - 1)
    low = F.floor(position).cast("int")
    at_low = F.get(ordered, low)
    at_high = F.get(ordered, F.least(low + 1, n - 1))
    return F.when(n == 1, F.get(ordered, F.lit(0))).when(
        n > 1, at_low + (position - low) * (at_high - at_low)
    )


def midpoint_median(ordered: Column) -> Column:
    """Median as the mean of the two central values of an ascending array."""
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n % 2 == 1, upper).when(n > 0, (lower + upper) / 2)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sample_deviation(ordered: Column) -> Column:
    """Two-pass sample standard deviation; null under two values."""
    n = F.size(ordered)
    mean = array_total(ordered) / n
    squares = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def percentile_rank(ordered: Column, value: Column) -> Column:
    """Position 0..100 of ``value`` in an ascending array, the inverse of linear_percentile.

    Values outside the array saturate, ties take the middle of the tied run.
    """
    n = F.size(ordered)
    below = F.size(F.filter(ordered, lambda x: x < value))
    equal = F.size(F.filter(ordered, lambda x: x == value))
    low = F.get(ordered, below - 1)
    high = F.get(ordered, below)
    tied = F.lit(100.0) * ((below + below + equal - 1) / F.lit(2.0)) / (n - 1)
    between = F.lit(100.0) * ((below - 1) + (value - low) / (high - low)) / (n - 1)
    return (
        F.when((n == 0) | value.isNull(), F.lit(None).cast("double"))
        .when((n == 1) & (equal == 1), F.lit(50.0))
        .when((below == 0) & (equal == 0), F.lit(0.0))
        .when(below == n, F.lit(100.0))
        .when(equal > 0, tied)
        .otherwise(between)
    )


def floor_index_cut(ordered: Column, p: float) -> Column:
    """Element at floor(p * (n - 1)) without interpolation, as map legends use."""
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.floor(F.lit(float(p)) * (n - 1)).cast("int")))


def sorted_values(rows: Column, keep: Callable[[Column], Column], field: str = "valor") -> Column:
    """Ascending array of ``field`` over the structs of ``rows`` that pass ``keep``."""
    return F.array_sort(F.transform(F.filter(rows, keep), lambda x: x[field]))
