"""MMWR week arithmetic on date columns.

Weeks start on Sunday and belong to the year of their Wednesday, so a year has
52 or 53 weeks. Nothing here needs a calendar table or a range join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# First Sunday of the Unix era; week_index counts weeks from here.
FIRST_SUNDAY = "1970-01-04"


def week_start(day: Column) -> Column:
    """Sunday on or before ``day``."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def mmwr_year(start: Column) -> Column:
    """Year of the week that begins on ``start``."""
    return F.year(F.date_add(start, 3))


def mmwr_week(start: Column) -> Column:
    """Number (1..53) of the week that begins on ``start``."""
    return (F.floor((F.dayofyear(F.date_add(start, 3)) - 1) / 7) + 1).cast("int")


def week_index(start: Column) -> Column:
    """Chronological week number, independent of year boundaries."""
    return F.floor(F.datediff(start, F.lit(FIRST_SUNDAY).cast("date")) / 7).cast("int")


def first_week_start(year: Column) -> Column:
    """Sunday that opens week 1 of ``year``: the week that holds the first Wednesday."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return week_start(jan4)


def start_of(year: Column, week: Column) -> Column:
    """Sunday that opens ``week`` of ``year``."""
    return F.date_add(first_week_start(year), (week - 1) * 7)


def _opening(year: int) -> date:
    jan4 = date(year, 1, 4)
    return jan4 - timedelta(days=(jan4.weekday() + 1) % 7)


def week_ranges(years: Iterable[int], weeks: Iterable[int] | None = None) -> list[tuple[date, date]]:
    """Days of the given weeks (all when None) of the given years as merged, half-open ranges; weeks a year lacks add none."""
    spans = []
    for year in sorted(set(years)):
        first, after = _opening(year), _opening(year + 1)
        if weeks is None:
            spans.append((first, after))
            continue
        for week in sorted(set(weeks)):
            start = first + timedelta(days=7 * (week - 1))
            if week >= 1 and start < after:
                spans.append((start, start + timedelta(days=7)))
    merged: list[tuple[date, date]] = []
    for first, after in spans:
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(after, merged[-1][1]))
        else:
            merged.append((first, after))
    return merged


def in_ranges(day: Column, ranges: Sequence[tuple[date, date]]) -> Column:
    """Whether a stored date or timestamp lies in one of the ranges; plain comparisons, so scans can skip by them."""
    keep = F.lit(False)
    for first, after in ranges:
        keep = keep | ((day >= F.lit(first)) & (day < F.lit(after)))
    return keep
