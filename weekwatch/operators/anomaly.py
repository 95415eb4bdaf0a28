"""Suitability series and their standardised anomaly against the same week of other years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions import suitability
from weekwatch.functions.percentiles import linear_percentile, midpoint_median, sample_deviation
from weekwatch.operators import contracts, pools

REQUIRED = ("temp_media", "precipitation_sum", "humedad_relativa_media")


def two_week_rain(weekly: DataFrame, keys: Sequence[str], rain: str = "precipitation_sum") -> Column:
    """Rain of a week and the one before in the same year; a missing previous week adds nothing."""
    year = Window.partitionBy(*keys, "anio").orderBy("semana").rangeBetween(-1, -1)
    return F.col(rain) + F.coalesce(F.max(rain).over(year), F.lit(0.0))


def suitability_series(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index per key and week from a wide weekly table.

    Rain of incomplete weeks still counts as the previous week of the next one;
    only weeks with all three variables get an index.
    """
    known = weekly.withColumn("lluvia_2s", two_week_rain(weekly, keys)).dropna(subset=list(REQUIRED))
    iv = suitability.index(F.col("temp_media"), F.col("lluvia_2s"), F.col("humedad_relativa_media"))
    return known.select(*keys, "anio", "semana", iv.alias("iv"))


def baseline(cells: DataFrame, min_obs: int = 3) -> DataFrame:
    """Median and sample deviation (null under ``min_obs``), quartiles, and z of ``valor``."""
    enough = F.col("n_obs") >= min_obs
    cells = cells.withColumns(
        {
            "mediana": F.when(enough, midpoint_median(F.col("pool"))),
            "desviacion": F.when(enough, sample_deviation(F.col("pool"))),
            "p25": linear_percentile(F.col("pool"), 0.25),
            "p75": linear_percentile(F.col("pool"), 0.75),
        }
    )
    return cells.withColumn("z", z_score(F.col("valor"), F.col("mediana"), F.col("desviacion")))


def z_score(value: Column, median: Column, deviation: Column) -> Column:
    """Null when the baseline is missing or degenerate."""
    return F.when(deviation >= 1e-9, (value - median) / deviation)


def same_week_anomaly(series: DataFrame, keys: Sequence[str], value: str, corpus: Sequence[int]) -> DataFrame:
    """Every observed week against the same week of the other corpus years."""
    rows = series.select(*keys, "anio", "semana", F.col(value).alias("valor"))
    return baseline(pools.observed_cells(rows, keys, pools.others_in(corpus), window=0))


def anomaly_of_year(series: DataFrame, keys: Sequence[str], value: str, corpus: Sequence[int], year: int) -> DataFrame:
    """All weeks seen in any year, described for ``year``; the real value may be null."""
    rows = series.select(*keys, "anio", "semana", F.col(value).alias("valor"))
    return baseline(pools.described_year(rows, keys, pools.others_in(corpus), year, window=0))


def degeneracy(values: DataFrame, column: str) -> DataFrame:
    """One row of summary figures that shows a constant or saturated index."""
    v = F.col(column)
    bins = F.least(F.floor(v * 10), F.lit(9))
    return values.agg(
        F.count(v).alias("n"),
        F.avg(v).alias("media"),
        F.stddev_samp(v).alias("desviacion"),
        F.min(v).alias("minimo"),
        F.max(v).alias("maximo"),
        (F.count_if(v < 0.01) / F.count(v)).alias("fraccion_cero"),
        (F.count_if(v > 0.99) / F.count(v)).alias("fraccion_uno"),
        *[F.count_if(bins == i).alias(f"decil_{i}") for i in range(10)],
    )


def require_variation(values: DataFrame, column: str) -> DataFrame:
    """The same rows; the job aborts when ``degeneracy`` shows that the index does not vary, or nearly never does."""
    stats = degeneracy(values, column)
    broken = (
        F.when(F.coalesce(F.col("desviacion"), F.lit(0.0)) < 1e-6, "index is constant over the corpus")
        .when((F.col("fraccion_cero") > 0.95) | (F.col("fraccion_uno") > 0.95), "index is saturated over the corpus")
    )
    verdict = stats.select(broken.alias("falla")).scalar()
    checked = contracts.require(values.withColumn("_falla", verdict), F.col("_falla").isNull(), F.col("_falla"))
    return checked.drop("_falla")
