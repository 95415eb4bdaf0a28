"""The user-level queries: parameters in, one logical plan out, nothing collected.

``fact`` is the case fact (region, clasificacion, anio, semana, conteo, ...),
``weekly`` the weekly weather, wide (region, anio, semana and one column per variable) or long (variable, valor), and
``regions`` the region catalogue (region, codigo, nombre, nivel_admin, ...).

A query of some weeks of some years says which days it reads (``*_days``); a fact that stores the first day of its weeks
in ``fecha`` is cut by them here, a source of days by its reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.functions import calendar as cal
from weekwatch.operators import anomaly, pressure, summary
from weekwatch.operators.weekly import known, pivot_variables

# Series of the pressure view and note of a week without weather.
SERIES = ("probable", "confirmado")
NOTE_NO_WEATHER = "sin datos climáticos completos para esta semana/año en este departamento"


def _departments(regions: DataFrame, codigo: str | None = None) -> DataFrame:
    rows = regions.filter(F.col("nivel_admin") == 1)
    if codigo is not None:
        rows = rows.filter(F.col("codigo") == codigo)
    return rows.select("region", "codigo", "nombre")


def national_series(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekly national counts with the first day of their week, in order."""
    weeks = calendar.select("anio", "semana", F.col("fecha_inicio").alias("semana_inicio"))
    return (
        series.select("anio", "semana", "conteo")
        .join(weeks, ["anio", "semana"])
        .orderBy("anio", "semana")
        .select("semana_inicio", "anio", "conteo")
    )


def regional_cases(regions: DataFrame, fact: DataFrame, fuente: str) -> DataFrame:
    """Descriptive summary of both laboratory series of one source per region."""
    own = fact.filter(F.col("fuente") == fuente)
    return summary.region_case_summary(regions.filter("nivel_admin = 1"), own).orderBy("nombre")


def notified_cases(regions: DataFrame, fact: DataFrame) -> DataFrame:
    """Summary of the notified series per region."""
    return summary.region_class_summary(regions.filter("nivel_admin = 1"), fact, "notificado").orderBy("nombre")


def notified_series(regions: DataFrame, fact: DataFrame, codigo: str | None = None) -> DataFrame:
    """Per region and year: [[week, count], ...] in week order; weeks without rows stay absent."""
    rows = (
        fact.filter(F.col("clasificacion") == "notificado")
        .join(_departments(regions, codigo), "region")
        .groupBy("codigo", "nombre", "anio", "semana")
        .agg(F.sum("conteo").alias("conteo"))
    )
    pairs = F.array_sort(F.collect_list(F.struct("semana", "conteo")))
    return rows.groupBy("codigo", "nombre", "anio").agg(
        F.transform(pairs, lambda p: F.array(p["semana"].cast("bigint"), p["conteo"])).alias("serie")
    )


def _within(rows: DataFrame, ranges) -> DataFrame:
    return rows.filter(cal.in_ranges(F.col("fecha"), ranges)) if "fecha" in rows.columns else rows


def _case_series(fact: DataFrame, years: Sequence[int], weeks: Sequence[int] | None) -> DataFrame:
    keep = F.col("clasificacion").isin(*SERIES) & F.col("anio").isin(*years)
    if weeks is not None:
        keep = keep & F.col("semana").isin(*weeks)
    rows = _within(fact, cal.week_ranges(years, weeks)).filter(keep).groupBy("region", "clasificacion", "anio", "semana")
    return rows.agg(F.sum("conteo").cast("double").alias("valor"))


def _side_by_side(cells: DataFrame) -> DataFrame:
    """Both series of a (region, semana) in one row; ``vista`` tells that some year has either in that week."""
    fields = F.struct(*pressure.FIELDS)
    return cells.groupBy("region", "semana").agg(
        *[F.max(F.when(F.col("clasificacion") == name, fields)).alias(name) for name in SERIES], F.bool_or("vista").alias("vista"))


def _columns(wide: DataFrame, year: int) -> DataFrame:
    """Fields of both series as columns; a series without cell is an empty baseline."""
    empty = {"n_obs_baseline": F.lit(0).cast("bigint"), "anios_baseline": F.lit(0).cast("bigint"), "nota": F.lit(pressure.NOTE_INSUFFICIENT)}

    def field(name: str, f: str):
        own = F.col(f"{name}.{f}")
        return (F.when(F.col(name).isNull(), empty[f]).otherwise(own) if f in empty else own).alias(f"{name}_{f}")

    return wide.select(
        "region", "codigo", "nombre", "semana", *[field(name, f) for name in SERIES for f in pressure.FIELDS], F.lit(year).alias("anio"))


def _neighbours(week: int) -> list[int]:
    return [w for w in (week - 1, week, week + 1) if w >= 1]


def pressure_days(base_years: Sequence[int], year: int, week: int | None = None):
    """Days that the pressure of a year, or of one of its weeks, depends on."""
    return cal.week_ranges({*base_years, year}, None if week is None else _neighbours(week))


def pressure_of_week(fact: DataFrame, regions: DataFrame, base_years: Sequence[int], week: int, year: int) -> DataFrame:
    """Relative pressure of all regions in one week; only neighbour weeks and needed years are read, once."""
    series = _case_series(fact, sorted({*base_years, year}), _neighbours(week))
    cells = pressure.of_year(series, ["region", "clasificacion"], base_years, year)
    wide = _side_by_side(cells.filter(F.col("semana") == week)).drop("semana")
    return _columns(_departments(regions).withColumn("semana", F.lit(week)).join(wide, "region", "left"), year)


def pressure_of_region(
    fact: DataFrame, regions: DataFrame, base_years: Sequence[int], year: int, codigo: str | None = None
) -> DataFrame:
    """Pressure series of one region (all when None) over every week it was seen in."""
    own = _departments(regions, codigo)
    series = _case_series(fact, sorted({*base_years, year}), None)
    if codigo is not None:
        series = series.join(own.select("region"), "region", "left_semi")
    cells = pressure.of_year(series, ["region", "clasificacion"], base_years, year)
    return _columns(own.join(_side_by_side(cells).filter("vista"), "region"), year)


def _suitability(weekly: DataFrame) -> DataFrame:
    if "variable" in weekly.columns:
        wide = pivot_variables(weekly, ["region"], anomaly.REQUIRED, complete=False)
    else:
        wide = known(weekly, anomaly.REQUIRED, complete=False)
    return anomaly.suitability_series(wide, ["region"])


def _with_previous(week: int) -> list[int]:
    return [week] if week == 1 else [week - 1, week]


def suitability_days(corpus: Sequence[int], week: int | None = None):
    """Days that the suitability of the corpus, or of one week in it, depends on."""
    return cal.week_ranges(corpus, None if week is None else _with_previous(week))


def suitability_of_week(weekly: DataFrame, regions: DataFrame, corpus: Sequence[int], week: int, year: int) -> DataFrame:
    """Suitability and its anomaly of all regions in one week; a region without weather keeps a note."""
    rows = weekly.filter(F.col("anio").isin(*corpus) & F.col("semana").isin(*_with_previous(week)))
    cells = anomaly.anomaly_of_year(_suitability(rows), ["region"], "iv", corpus, year)
    own = cells.filter((F.col("semana") == week) & F.col("valor").isNotNull()).select("region", "valor", "z")
    return _departments(regions).join(own, "region", "left").select(
        "region",
        "codigo",
        "nombre",
        F.round("valor", 4).alias("iv"),
        F.round("z", 4).alias("anomaly_sigma"),
        F.when(F.col("valor").isNull(), NOTE_NO_WEATHER).alias("nota"),
    )


def suitability_of_region(
    weekly: DataFrame, regions: DataFrame, corpus: Sequence[int], year: int, codigo: str | None = None
) -> DataFrame:
    """Historic band against the real series of ``year`` for every week seen in any year."""
    own = _departments(regions, codigo)
    rows = weekly.filter(F.col("anio").isin(*corpus))
    if codigo is not None:
        rows = rows.join(own.select("region"), "region", "left_semi")
    cells = anomaly.anomaly_of_year(_suitability(rows), ["region"], "iv", corpus, year)
    return cells.join(own, "region").select(
        "codigo",
        "nombre",
        F.col("semana"),
        F.round("valor", 4).alias("iv_real"),
        F.round("p25", 4).alias("p25_baseline"),
        F.round("mediana", 4).alias("mediana_baseline"),
        F.round("p75", 4).alias("p75_baseline"),
        F.round("z", 4).alias("anomaly_sigma"),
    )


def region_profile(suitability_rows: DataFrame, pressure_rows: DataFrame) -> DataFrame:
    """Suitability, anomaly and both pressures of a week side by side per region."""
    return suitability_rows.select("region", "codigo", "nombre", "iv", "anomaly_sigma").join(
        pressure_rows.select(
            "region",
            *[f"{s}_{f}" for s in SERIES for f in ("percentil", "categoria", "casos_observados", "nota")],
        ),
        "region",
        "left",
    )
