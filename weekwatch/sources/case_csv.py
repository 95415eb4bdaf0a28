"""Public weekly case extract: one row per place, interval and resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.functions import calendar as cal
from weekwatch.operators import contracts
from weekwatch.operators.upsert import last_wins
from weekwatch.sources.positions import positioned
from weekwatch.sources.tables import by_name

# Column names of the extract and the codes of a national weekly row.
COLUMNS = (
    "adm_0_name", "Year", "calendar_start_date", "calendar_end_date",
    "S_res", "T_res", "case_definition_standardised", "dengue_total",
)
NATIONAL, WEEKLY, DEFINITION = "Admin0", "Week", "Total"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The known columns as text, found by header name; each reader casts what it needs."""
    return by_name(spark, path, ", ".join(f"`{c}` string" for c in COLUMNS))


def _weekly_national(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("S_res") == NATIONAL) & (F.col("T_res") == WEEKLY))


def national_weeks(spark: SparkSession, path: str) -> DataFrame:
    """Country-level weekly counts by start date; an unknown case definition aborts the job that reads them.

    The printed year is the calendar year and is ignored: the week decides later.
    """
    rows = _weekly_national(read(spark, path))
    rows = contracts.require(
        rows, F.col("case_definition_standardised").eqNullSafe(DEFINITION),
        contracts.named("unexpected case definition", ["adm_0_name", "calendar_start_date", "case_definition_standardised"]))
    return rows.select(
        F.col("adm_0_name").alias("pais"),
        F.col("calendar_start_date").cast("date").alias("fecha_inicio"),
        F.col("dengue_total").cast("double").cast("bigint").alias("conteo"),
    )


def lenient_weeks(spark: SparkSession, path: str, years: Sequence[int]) -> DataFrame:
    """Weekly counts of many countries: unreadable numbers are skipped, the last row of a date wins."""
    rows = _weekly_national(positioned(read(spark, path))).select(
        F.col("adm_0_name").alias("pais"),
        F.col("Year").try_cast("int").alias("anio"),
        F.col("calendar_start_date").cast("date").alias("fecha"),
        F.col("dengue_total").try_cast("double").alias("valor"),
        "posicion",
    )
    known = rows.filter(F.col("valor").isNotNull() & F.col("anio").isin(*years))
    return last_wins(known, ["pais", "anio", "fecha"], ["posicion"]).drop("posicion")


def strict_weeks(
    spark: SparkSession, path: str, filters: Mapping[str, str], first_year: int, last_year: int,
    rows_per_country: Mapping[str, int] | None = None,
) -> DataFrame:
    """Weekly counts under a frozen contract: seven-day intervals, no duplicates, expected row counts. The job that reads
    them aborts where it is broken.

    ``anio`` and ``semana`` come from the start date; ``anio_declarado`` is the printed year.
    """
    rows = read(spark, path)
    for column, value in filters.items():
        rows = rows.filter(F.col(column) == value)
    start, end = F.col("calendar_start_date").cast("date"), F.col("calendar_end_date").cast("date")
    rows = contracts.require(
        rows, F.datediff(end, start).eqNullSafe(6),
        contracts.named("interval is not seven days", ["adm_0_name", "calendar_start_date", "calendar_end_date"]))
    week = cal.week_start(start)
    result = rows.select(
        F.col("adm_0_name").alias("pais"),
        cal.mmwr_year(week).alias("anio"),
        cal.mmwr_week(week).alias("semana"),
        start.alias("fecha"),
        F.col("dengue_total").cast("double").alias("valor"),
        F.col("Year").cast("int").alias("anio_declarado"),
    ).filter(F.col("anio").between(first_year, last_year))
    result = contracts.unique(result, ["pais", "anio", "semana"], "duplicate week")
    if rows_per_country is not None:
        frozen = spark.createDataFrame(list(rows_per_country.items()), "esperado string, filas bigint")
        counted = result.groupBy("pais").agg(F.count(F.lit(1)).alias("n"))
        both = counted.join(frozen, F.col("pais").eqNullSafe(F.col("esperado")), "full")
        wrong = both.filter(~F.col("n").eqNullSafe(F.col("filas")))
        result = contracts.without(result, wrong, contracts.named("row count differs from the frozen one", ["pais", "n", "esperado", "filas"]))
    return result
