"""Summaries of case facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions.classify import first_break
from weekwatch.operators.ranking import running_totals, values_at


def weekly_series(fact: DataFrame, keys: Sequence[str], value: str = "conteo") -> DataFrame:
    """Sum per key, year and week."""
    return fact.groupBy(*keys, "anio", "semana").agg(F.sum(value).alias(value))


def region_case_summary(regions: DataFrame, fact: DataFrame) -> DataFrame:
    """Per region: totals of both laboratory series, weeks with data and year span.

    Regions without rows keep zeros. ``fact`` is already limited to its source.
    Facts collapse to (region, year, week) on the map side before the join.
    """
    probable = F.col("clasificacion") == "probable"
    weeks = fact.groupBy("region", "anio", "semana").agg(
        F.sum(F.when(probable, F.col("conteo"))).alias("probable"),
        F.sum(F.when(F.col("clasificacion") == "confirmado", F.col("conteo"))).alias("confirmado"),
    )
    sums = weeks.groupBy("region").agg(
        F.sum("probable").alias("probable_total"),
        F.sum("confirmado").alias("confirmado_total"),
        F.count("probable").alias("semanas_con_dato_probable"),
        F.min("anio").alias("primer_anio"),
        F.max("anio").alias("ultimo_anio"),
    )
    return regions.join(sums, "region", "left").select(
        "nombre",
        "codigo",
        F.coalesce("probable_total", F.lit(0)).alias("probable_total"),
        F.coalesce("confirmado_total", F.lit(0)).alias("confirmado_total"),
        F.coalesce("semanas_con_dato_probable", F.lit(0)).alias("semanas_con_dato_probable"),
        "primer_anio",
        "ultimo_anio",
    )


def region_class_summary(regions: DataFrame, fact: DataFrame, clasificacion: str) -> DataFrame:
    """Per region: total, rows and year span of one class.

    Rows are counted on the fact side, so a region without rows gets 0 (a plain
    count over a left join would give it 1).
    """
    sums = fact.filter(F.col("clasificacion") == clasificacion).groupBy("region").agg(
        F.sum("conteo").alias("total"),
        F.count("conteo").alias("semanas_con_dato"),
        F.min("anio").alias("primer_anio"),
        F.max("anio").alias("ultimo_anio"),
    )
    return regions.join(sums, "region", "left").select(
        "nombre",
        "codigo",
        F.coalesce("total", F.lit(0)).alias(f"{clasificacion}_total"),
        F.coalesce("semanas_con_dato", F.lit(0)).alias("semanas_con_dato"),
        "primer_anio",
        "ultimo_anio",
    )


def national_kpis(series: DataFrame) -> DataFrame:
    """One row: total, peak and its first date, span, weeks loaded and chart levels."""
    return series.agg(
        F.sum("conteo").alias("total"),
        F.max("conteo").alias("pico"),
        F.max_by("fecha", F.struct("conteo", -F.datediff("fecha", F.lit("1970-01-01")))).alias("fecha_pico"),
        F.min("anio").alias("primer_anio"),
        F.max("anio").alias("ultimo_anio"),
        F.count(F.lit(1)).alias("semanas"),
        F.min("fecha").alias("primera_semana"),
        F.max("fecha").alias("ultima_semana"),
        (F.max("conteo") / 2).alias("nivel_medio"),
    )


def first_week_per_year(series: DataFrame) -> DataFrame:
    return series.groupBy("anio").agg(F.min("fecha").alias("primera_fecha"), F.min_by("semana", "fecha").alias("primera_semana"))


def yearly_correlation(series: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation between the total of a year and its number of high weeks."""
    totals = series.groupBy(*keys, "anio").agg(F.sum("valor").alias("total_anual"))
    highs = labels.groupBy(*keys, "anio").agg(F.count_if(F.col("etiqueta") == "alto").alias("altas"))
    joined = totals.join(highs, [*keys, "anio"])
    # corr() itself divides by zero where one of the two never varies
    high = F.col("altas").cast("double")
    r = F.covar_pop("total_anual", high) / F.nullif(F.stddev_pop("total_anual") * F.stddev_pop(high), F.lit(0.0))
    return joined.groupBy(*keys).agg(
        r.alias("r"),
        F.count(F.lit(1)).alias("anios"),
        F.count_if(F.col("altas") > 0).alias("anios_con_alta"),
    )


def coverage(weeks: DataFrame, keys: Sequence[str], years: Sequence[int], min_weeks: int) -> DataFrame:
    """Keys with at least ``min_weeks`` weeks in every one of ``years``."""
    per_year = weeks.filter(F.col("anio").isin(*years)).groupBy(*keys, "anio").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_year.filter(F.col("n") >= min_weeks)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("anios_completos"))
        .filter(F.col("anios_completos") == len(years))
    )


def without_coverage(weeks: DataFrame, weather: DataFrame, key: str) -> DataFrame:
    """Keys none of whose weeks has weather."""
    joined = weeks.select(key, "anio", "semana").join(
        weather.select(key, "anio", "semana", F.lit(1).alias("hay")), [key, "anio", "semana"], "left"
    )
    return (
        joined.groupBy(key)
        .agg(F.count(F.lit(1)).alias("semanas"), F.count("hay").alias("con_clima"))
        .filter(F.col("con_clima") == 0)
    )


def volume_ranking(series: DataFrame, key: str, years: Sequence[int], min_weeks: int = 8, min_years: int = 3) -> DataFrame:
    """Volume, years with enough active weeks and whether the key qualifies for its own channel."""
    per_year = series.filter(F.col("anio").isin(*years)).groupBy(key, "anio").agg(
        F.sum("valor").alias("volumen"), F.count_if(F.col("valor") > 0).alias("no_cero")
    )
    return per_year.groupBy(key).agg(
        F.sum("volumen").alias("volumen_total"),
        F.count_if(F.col("no_cero") >= min_weeks).alias("anios_con_actividad"),
    ).withColumn("califica", F.col("anios_con_actividad") >= min_years)


def rank_by_volume(volumes: DataFrame, key: str) -> DataFrame:
    """Rank of each key by volume, equal volumes by key; no task sees more than one range of volumes."""
    counted = running_totals(volumes.select("volumen_total", F.lit(1).alias("n")), "volumen_total", ["n"], descending=True)
    equals = Window.partitionBy("volumen_total").orderBy(key)
    ranked = volumes.join(counted.select("volumen_total", "n_antes"), "volumen_total")
    return ranked.withColumn("puesto", (F.col("n_antes") + F.row_number().over(equals)).cast("bigint")).select(*volumes.columns, "puesto")


def map_breaks(rows: DataFrame, value: str, shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Legend bin of each region by quintile cuts of the known values.

    A cut is the value at floor(share * (n - 1)) of the ascending order, found by running totals, not in one array.
    """
    places = {f"c{i}": F.floor(F.lit(float(share)) * (F.col("n") - 1)) for i, share in enumerate(shares)}
    cut = rows.withColumn("_cortes", values_at(rows, value, places).select(F.struct("*")).scalar())
    return cut.withColumn("tramo", first_break(F.col(value), [F.col(f"_cortes.{c}") for c in places])).drop("_cortes")
