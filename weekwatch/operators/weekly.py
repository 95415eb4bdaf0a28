"""Daily weather to weekly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import calendar as cal
from weekwatch.operators import contracts

#: Days keep six decimals; only the weekly value is rounded to three.
DAILY = "decimal(16,6)"


def guard_false_zero(days: DataFrame, hours: str = "precipitation_hours", total: str = "precipitation_sum") -> DataFrame:
    """Rain hours are unknown on days whose rain sum is unknown, even when printed as 0."""
    return days.withColumn(hours, F.when(F.col(total).isNotNull(), F.col(hours)))


def to_long(days: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One row per known value of each variable."""
    return days.unpivot(list(keys), list(variables), "variable", "valor").filter(F.col("valor").isNotNull())


def weekly_wide(days: DataFrame, keys: Sequence[str], variables: Sequence[str], sums: Sequence[str], day: str = "fecha") -> DataFrame:
    """Weekly value of every variable, null where no day is known: sum for accumulative ones, mean otherwise, 3 decimals.

    One pass over the wide days keeps a sum and a count for each variable. Values are decimals, so the result does not
    depend on the order of the rows.
    """
    start = cal.week_start(F.col(day))
    aggregates = []
    for v in variables:
        aggregates += [F.sum(F.col(v).cast(DAILY)).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}")]
    weeks = days.groupBy(*keys, start.alias("_inicio")).agg(*aggregates)

    def value(v: str) -> Column:
        total = F.col(f"_s_{v}")
        chosen = total if v in sums else F.round(total / F.col(f"_n_{v}"), 3)
        return chosen.cast("decimal(10,3)").alias(v)

    return weeks.select(
        *keys, cal.mmwr_year(F.col("_inicio")).alias("anio"), cal.mmwr_week(F.col("_inicio")).alias("semana"), *[value(v) for v in variables]
    )


def stacked(wide: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One row per known weekly value; only where the long form itself is wanted."""
    return wide.unpivot([*keys, "anio", "semana"], list(variables), "variable", "valor").filter(F.col("valor").isNotNull())


def weekly_long(days: DataFrame, keys: Sequence[str], variables: Sequence[str], sums: Sequence[str], day: str = "fecha") -> DataFrame:
    """Weekly value per variable in rows."""
    return stacked(weekly_wide(days, keys, variables, sums, day), keys, variables)


def known(wide: DataFrame, variables: Sequence[str], complete: bool = True) -> DataFrame:
    """Weeks that know some of the variables, or with ``complete`` all of them, as doubles."""
    others = [c for c in wide.columns if c not in variables]
    kept = wide.dropna(how="any" if complete else "all", subset=list(variables))
    return kept.select(*others[: others.index("semana") + 1], *[F.col(v).cast("double").alias(v) for v in variables])


def weekly_complete(
    days: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    sums: Sequence[str],
    min_days: int = 5,
    day: str = "fecha",
) -> DataFrame:
    """Weekly wide table of the weeks in which every variable has ``min_days`` known days.

    All variables are aggregated in one pass over the wide days.
    """
    start = cal.week_start(F.col(day))
    aggregates = []
    for v in variables:
        aggregates += [F.sum(F.col(v).cast("decimal(10,3)")).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}")]
    weeks = days.groupBy(*keys, start.alias("_inicio")).agg(*aggregates)
    enough = F.least(*[F.col(f"_n_{v}") for v in variables]) >= min_days

    def value(v: str) -> Column:
        total = F.col(f"_s_{v}").cast("double")
        return (total if v in sums else total / F.col(f"_n_{v}")).alias(v)

    return weeks.filter(enough).select(
        *keys,
        cal.mmwr_year(F.col("_inicio")).alias("anio"),
        cal.mmwr_week(F.col("_inicio")).alias("semana"),
        F.col("_inicio").alias("fecha"),
        *[value(v) for v in variables],
    )


def national_mean(weekly: DataFrame, level0: DataFrame | None = None) -> DataFrame:
    """Unweighted mean over regions per week and variable with the number of regions.

    ``level0`` rows are already national and are taken as they are.
    """
    n = F.count(F.lit(1))
    means = weekly.groupBy("anio", "semana", "variable").agg(
        (F.sum("valor").cast("double") / n).alias("valor"), n.alias("n_regiones")
    )
    if level0 is None:
        return means
    own = level0.select(
        "anio", "semana", "variable", F.col("valor").cast("double").alias("valor"), F.lit(None).cast("bigint").alias("n_regiones")
    )
    return means.unionByName(own)


def national_wide(wide: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Unweighted mean over regions per week, one column per variable, with ``n_<variable>`` regions."""
    means = [(F.sum(v).cast("double") / F.count(v)).alias(v) for v in variables]
    return wide.groupBy("anio", "semana").agg(*means, *[F.count(v).alias(f"n_{v}") for v in variables])


def national_rows(means: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``national_wide`` with one row per known value and its number of regions."""
    rows = [F.struct(F.lit(v).alias("variable"), F.col(v).alias("valor"), F.col(f"n_{v}").alias("n_regiones")) for v in variables]
    return means.select("anio", "semana", F.inline(F.array(*rows))).filter(F.col("n_regiones") > 0)


def strict_national_mean(weekly: DataFrame, n_regions: Column | int, key: str = "region") -> tuple[DataFrame, DataFrame]:
    """National mean only where every region reported, and the groups that fall short.

    A region that reports a week and variable twice aborts the job: its mean would count it twice.
    """
    n = F.count(F.lit(1))
    groups = weekly.groupBy("anio", "semana", "variable").agg(
        (F.sum("valor").cast("double") / n).alias("valor"), n.alias("n_regiones"), F.count_distinct(key).alias("_distintas")
    )
    once = F.col("n_regiones") == F.col("_distintas")
    means = contracts.require(groups, once, contracts.named("repeated weekly values", ["anio", "semana", "variable"])).drop("_distintas")
    full = F.col("n_regiones") == n_regions
    return means.filter(full), means.filter(~full).select("anio", "semana", "variable", "n_regiones")


def duplicates(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their rows; ``strict_national_mean`` aborts on them."""
    return weekly.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas")).filter("filas > 1")


def pivot_variables(weekly: DataFrame, keys: Sequence[str], variables: Sequence[str], complete: bool = True) -> DataFrame:
    """Wide weekly table; with ``complete`` a week that lacks any variable is dropped."""
    value = lambda v: F.max(F.when(F.col("variable") == v, F.col("valor").cast("double"))).alias(v)
    wide = (
        weekly.filter(F.col("variable").isin(*variables))
        .groupBy(*keys, "anio", "semana")
        .agg(*[value(v) for v in variables])
    )
    return wide.dropna(subset=list(variables)) if complete else wide


def common_to_all(series: DataFrame, key: str, n_keys: Column | int, value: str) -> DataFrame:
    """Mean over keys of the weeks every key has."""
    return (
        series.groupBy("anio", "semana")
        .agg(F.count_distinct(key).alias("n"), F.avg(value).alias(value))
        .filter(F.col("n") == n_keys)
        .drop("n")
    )
