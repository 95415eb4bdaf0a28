"""Histories of one cell: the same weeks of other years.

A theta self-join on the week distance would be a nested loop or a skewed
equi-join. Instead every observation is sent to the weeks it is a neighbour of
and grouped there, which takes one shuffle on (keys, week). A group holds at
most years x (2 * window + 1) rows whatever the size of the facts, because the
series is already aggregated to one row per week.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.percentiles import linear_percentile, sorted_values

Rule = Callable[[Column, Column], Column]


def neighbourhoods(series: DataFrame, keys: Sequence[str], window: int = 1) -> DataFrame:
    """Per key and week: ``vecinas``, all observations within ``window`` weeks of any year.

    Weeks do not wrap over year ends. ``series`` has (keys, anio, semana, valor).
    """
    weeks = F.sequence(F.greatest(F.col("semana") - window, F.lit(1)), F.col("semana") + window)
    spread = series.select(
        *keys,
        F.explode(weeks).alias("semana"),
        F.struct("anio", F.col("semana").alias("origen"), F.col("valor").cast("double").alias("valor")).alias("v"),
    )
    return spread.groupBy(*keys, "semana").agg(F.collect_list("v").alias("vecinas"))


def others_in(base_years: Sequence[int]) -> Rule:
    """Leave-one-out: base years other than the described one."""
    return lambda year, target: year.isin(*base_years) & (year != target)


def earlier_than(excluded: Sequence[int] = (), first_year: int | None = None) -> Rule:
    """Expanding history: only earlier years, without the excluded ones."""

    def rule(year: Column, target: Column) -> Column:
        keep = year < target
        if excluded:
            keep = keep & ~year.isin(*excluded)
        if first_year is not None:
            keep = keep & (year >= first_year)
        return keep

    return rule


def observed_cells(series: DataFrame, keys: Sequence[str], rule: Rule, window: int = 1) -> DataFrame:
    """One row per observation with its pool.

    Adds ``pool`` (ascending values), ``n_obs``, ``anios_presentes`` and
    ``claves``, the sorted (anio, semana) pairs the pool came from.
    """
    around = neighbourhoods(series, keys, window)
    own = F.filter("vecinas", lambda v: v["origen"] == F.col("semana"))
    targets = around.select(*keys, "semana", "vecinas", F.explode(own).alias("propia"))
    cells = targets.select(
        *keys, F.col("propia.anio").alias("anio"), "semana", F.col("propia.valor").alias("valor"), "vecinas"
    )
    return with_pool(cells, F.col("anio"), rule)


def described_year(series: DataFrame, keys: Sequence[str], rule: Rule, year: int, window: int = 1) -> DataFrame:
    """One row per key and week that any observation neighbours, described for ``year``.

    ``valor`` is null where the year itself has no observation; ``vista`` tells that some year has one in that week.
    """
    around = neighbourhoods(series, keys, window)
    target = F.lit(year)
    own = F.filter("vecinas", lambda v: (v["origen"] == F.col("semana")) & (v["anio"] == year))
    cells = around.select(
        *keys, target.alias("anio"), "semana", F.get(own, F.lit(0))["valor"].alias("valor"),
        F.exists("vecinas", lambda v: v["origen"] == F.col("semana")).alias("vista"), "vecinas"
    )
    return with_pool(cells, target, rule)


def with_pool(cells: DataFrame, target: Column, rule: Rule) -> DataFrame:
    """Reduce ``vecinas`` to the pool that ``rule`` allows for the target year."""
    keep = lambda v: rule(v["anio"], target)
    return (
        cells.withColumn("vecinas", F.filter("vecinas", keep))
        .withColumns(
            {
                "pool": sorted_values(F.col("vecinas"), lambda v: F.lit(True)),
                "n_obs": F.size("vecinas").cast("bigint"),
                "anios_presentes": F.size(
                    F.array_distinct(F.transform("vecinas", lambda v: v["anio"]))
                ).cast("bigint"),
                "claves": F.array_sort(
                    F.transform(
                        "vecinas", lambda v: F.struct(v["anio"].alias("anio"), v["origen"].alias("semana"))
                    )
                ),
            }
        )
        .drop("vecinas")
    )


def sufficient(min_obs: int = 12, min_years: int = 3) -> Column:
    """Floors under which a pool is too small to describe a cell."""
    return (F.col("n_obs") >= min_obs) & (F.col("anios_presentes") >= min_years)


def percentiles(cells: DataFrame, **named: float) -> DataFrame:
    """Add one column per name with that percentile of ``pool``."""
    return cells.withColumns({name: linear_percentile(F.col("pool"), p) for name, p in named.items()})
