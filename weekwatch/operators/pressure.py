"""Relative pressure: where a count lies within the history of its own region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.classify import PRESSURE, two_cuts
from weekwatch.functions.percentiles import linear_percentile, percentile_rank
from weekwatch.operators import pools

# Notes of a cell that has no rank.
NOTE_INSUFFICIENT = (
    "sin datos suficientes para baseline (menos de 3 años base con observaciones en la ventana ±1)"
)
NOTE_MISSING = (
    "sin observación registrada para esta semana/año en esta serie "
    "(hueco real de la fuente MINSAL, no un cero)"
)

FIELDS = (
    "casos_observados",
    "percentil",
    "categoria",
    "p50_baseline",
    "p75_baseline",
    "n_obs_baseline",
    "anios_baseline",
    "nota",
)


def describe(cells: DataFrame, keys: Sequence[str], min_years: int = 3) -> DataFrame:
    """Rank, category and cuts of pooled cells, or the note that says why there are none."""
    enough = F.col("anios_presentes") >= min_years
    usable = enough & F.col("valor").isNotNull()
    cells = cells.withColumns(
        {
            "p50": F.when(usable, linear_percentile(F.col("pool"), 0.50)),
            "p75": F.when(usable, linear_percentile(F.col("pool"), 0.75)),
            "rango": F.when(usable, percentile_rank(F.col("pool"), F.col("valor"))),
        }
    )
    return cells.select(
        *keys,
        "anio",
        "semana",
        F.col("valor").alias("casos_observados"),
        F.bround("rango", 1).alias("percentil"),
        two_cuts(F.col("valor"), F.col("p50"), F.col("p75"), PRESSURE).alias("categoria"),
        F.bround("p50", 1).alias("p50_baseline"),
        F.bround("p75", 1).alias("p75_baseline"),
        F.col("n_obs").alias("n_obs_baseline"),
        F.col("anios_presentes").alias("anios_baseline"),
        F.when(~enough, NOTE_INSUFFICIENT).when(F.col("valor").isNull(), NOTE_MISSING).alias("nota"),
    )


def observed(series: DataFrame, keys: Sequence[str], base_years: Sequence[int], min_years: int = 3) -> DataFrame:
    """Pressure of every observed cell."""
    cells = pools.observed_cells(series, keys, pools.others_in(base_years))
    return describe(cells, keys, min_years)


def of_year(series: DataFrame, keys: Sequence[str], base_years: Sequence[int], year: int, min_years: int = 3) -> DataFrame:
    """Pressure in ``year`` of every key and week that has neighbours in any year; ``vista`` tells that the week itself
    was seen in some year."""
    relevant = series.filter(F.col("anio").isin(*base_years, year))
    cells = pools.described_year(relevant, keys, pools.others_in(base_years), year)
    return describe(cells, [*keys, "vista"], min_years)
