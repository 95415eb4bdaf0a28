"""Calendar tables and alignment of dated rows to weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions import calendar as cal


def generate(years: DataFrame, first: str = "anio_min", last: str = "anio_max") -> DataFrame:
    """Weeks of every year between the bounds held in the single row of ``years``."""
    starts = F.sequence(
        cal.first_week_start(F.col(first)),
        F.date_sub(cal.first_week_start(F.col(last) + 1), 7),
        F.expr("interval 7 days"),
    )
    return years.select(F.explode(starts).alias("fecha_inicio")).select(
        cal.mmwr_year(F.col("fecha_inicio")).alias("anio"),
        cal.mmwr_week(F.col("fecha_inicio")).alias("semana"),
        "fecha_inicio",
        F.date_add("fecha_inicio", 6).alias("fecha_fin"),
    )


def with_week(rows: DataFrame, day: str, year: str = "anio", week: str = "semana") -> DataFrame:
    """Add MMWR year and week of a date column, by arithmetic only."""
    start = cal.week_start(F.col(day))
    return rows.withColumns({year: cal.mmwr_year(start), week: cal.mmwr_week(start)})


def days_of(calendar: DataFrame) -> DataFrame:
    """One row per calendar day with its year and week."""
    return calendar.select(
        "anio", "semana", F.explode(F.sequence("fecha_inicio", "fecha_fin")).alias("fecha")
    )


def join_days(rows: DataFrame, calendar: DataFrame, day: str = "fecha") -> tuple[DataFrame, DataFrame]:
    """Rows with the week of their day, and the distinct days the calendar lacks."""
    days = days_of(calendar).withColumnRenamed("fecha", day)
    matched = rows.join(F.broadcast(days), day)
    missing = rows.select(day).distinct().join(F.broadcast(days), day, "left_anti")
    return matched, missing


def join_week_start(rows: DataFrame, calendar: DataFrame, day: str = "fecha_inicio") -> tuple[DataFrame, DataFrame]:
    """Rows whose day is exactly a week start, and the rows whose day is not."""
    starts = calendar.select(F.col("fecha_inicio").alias(day), "anio", "semana")
    return rows.join(F.broadcast(starts), day), rows.join(F.broadcast(starts), day, "left_anti")


def ordinal_weeks(rows: DataFrame, keys: Sequence[str], day: str = "fecha") -> DataFrame:
    """Position 1..N of each dated row within its keys and year, with N kept.

    The window holds one year of one series, at most 53 rows.
    """
    group = Window.partitionBy(*keys, "anio")
    return rows.withColumns(
        {
            "semana": F.row_number().over(group.orderBy(day)),
            "n_semanas": F.count(F.lit(1)).over(group).cast("int"),
        }
    )


def weeks_in_years(
    rows: DataFrame, calendar: DataFrame, first_year: int, last_year: int, seen: Observation | None = None, day: str = "fecha_inicio"
) -> DataFrame:
    """Rows whose day is a week start of the given years, with their week.

    ``seen`` receives from the job that writes the rows how many it read, had no week, were out of the years and stay.
    """
    starts = calendar.select(F.col("fecha_inicio").alias(day), "anio", "semana")
    found = rows.join(F.broadcast(starts), day, "left")
    lost, inside = F.col("anio").isNull(), F.coalesce(F.col("anio").between(first_year, last_year), F.lit(False))
    if seen is not None:
        found = found.observe(
            seen, F.count(F.lit(1)).alias("leidas"), F.count_if(lost).alias("sin_semana"),
            F.count_if(~lost & ~inside).alias("fuera_de_rango"), F.count_if(inside).alias("cargadas"))
    return found.filter(inside)


def monthly_to_weekly(monthly: DataFrame, calendar: DataFrame, value: str = "anom", seen: Observation | None = None) -> DataFrame:
    """Every calendar week with the value of the month it starts in (null where unpublished).

    ``seen`` receives from the job that writes the weeks how many there are and how many have no value.
    """
    month = monthly.select(
        F.col("anio").alias("anio_mes"), F.col("mes").alias("mes_inicio"), value
    )
    weeks = calendar.withColumns(
        {"anio_mes": F.year("fecha_inicio"), "mes_inicio": F.month("fecha_inicio")}
    )
    joined = weeks.join(F.broadcast(month), ["anio_mes", "mes_inicio"], "left").drop("anio_mes", "mes_inicio")
    if seen is None:
        return joined
    return joined.observe(seen, F.count(F.lit(1)).alias("semanas"), F.count_if(F.col(value).isNull()).alias("sin_dato"))


def step_back(rows: DataFrame, keys: Sequence[str], steps: int) -> DataFrame:
    """Year and week ``steps`` weeks earlier, crossing years by their real length.

    ``rows`` comes from ordinal_weeks, so weeks are dense within a year. The
    target is null when a year on the way has no rows for the key.
    """
    years = Window.partitionBy(*keys).orderBy("anio")
    run = Window.partitionBy(*keys, "tramo").orderBy("anio", "semana")
    target = F.lag(F.struct("anio", "semana"), steps).over(run)
    return (
        rows.withColumn("tramo", F.col("anio") - F.dense_rank().over(years))
        .withColumn("previa", target)
        .withColumns({"anio_previo": F.col("previa.anio"), "semana_previa": F.col("previa.semana")})
        .drop("tramo", "previa")
    )


def contiguous_history(rows: DataFrame, keys: Sequence[str], weeks: int, day: str = "fecha") -> DataFrame:
    """Flag rows whose ``weeks`` previous weeks all exist, each exactly seven days apart.

    The frame is a range on the week index, so a gap shortens it by itself.
    """
    index = cal.week_index(F.col(day))
    frame = past_frame(keys, index, weeks)
    return rows.withColumn("historia_completa", F.count(F.lit(1)).over(frame) == weeks)


def past_frame(keys: Sequence[str], index: Column, weeks: int):
    """Window over the ``weeks`` weeks before the current one."""
    return Window.partitionBy(*keys).orderBy(index).rangeBetween(-weeks, -1)
