"""Season starts, anomaly alerts and the lead time between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekwatch.functions.percentiles import linear_percentile, midpoint_median

# Notes of years without a measurable lead time.
NOTE_DEGENERATE = "inicio en semana 1, lectura no confiable"
NOTE_NO_START = "sin inicio de temporada real detectado ese anio"
NOTE_NO_ALERT = "el detector no genero alerta ese anio"


def season_start(cells: DataFrame, keys: Sequence[str], require_sufficient: bool = False) -> DataFrame:
    """First week above its own P75 per key and year; null when no week crosses it."""
    rows = cells.filter(F.col("p75").isNotNull())
    if require_sufficient:
        rows = rows.filter("suficiente")
    crossing = F.min(F.when(F.col("valor") > F.col("p75"), F.col("semana")))
    return rows.groupBy(*keys, "anio").agg(crossing.alias("semana_inicio"))


def first_alert(anomalies: DataFrame, keys: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """First of two consecutive listed weeks at or above the threshold, and the yearly maximum.

    Consecutive means next in the list of weeks with data, not next by number.
    """
    year = Window.partitionBy(*keys, "anio").orderBy("semana")
    pair = (F.col("z") >= threshold) & (F.lead("z").over(year) >= threshold)
    return (
        anomalies.withColumn("_par", pair)
        .groupBy(*keys, "anio")
        .agg(F.min(F.when(F.col("_par"), F.col("semana"))).alias("semana_alerta"), F.max("z").alias("z_maximo"))
    )


def lead_time(starts: DataFrame, alerts: DataFrame, keys: Sequence[str], first_week_unreliable: bool = True) -> DataFrame:
    """Weeks from alert to real start (positive is early) with the reason when undefined.

    A start in week 1 is the mark of a degenerate year in regional series; national ones pass ``first_week_unreliable=False``.
    """
    joined = starts.join(alerts.select(*keys, "anio", "semana_alerta"), [*keys, "anio"], "left")
    note = (
        F.when(F.lit(first_week_unreliable) & (F.col("semana_inicio") == 1), NOTE_DEGENERATE)
        .when(F.col("semana_inicio").isNull(), NOTE_NO_START)
        .when(F.col("semana_alerta").isNull(), NOTE_NO_ALERT)
    )
    return joined.withColumns({"adelanto": F.col("semana_inicio") - F.col("semana_alerta"), "nota": note})


def lead_time_summary(leads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, quartiles and share of early alerts per key over its reliable years."""
    usable = leads.filter(F.col("nota").isNull())
    pooled = usable.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col("adelanto").cast("double"))).alias("pool"),
        F.count_if(F.col("adelanto") > 0).alias("positivos"),
    )
    return pooled.select(
        *keys,
        F.size("pool").cast("bigint").alias("medibles"),
        midpoint_median(F.col("pool")).alias("mediana"),
        linear_percentile(F.col("pool"), 0.25).alias("q1"),
        linear_percentile(F.col("pool"), 0.75).alias("q3"),
        (F.col("positivos") / F.size("pool")).alias("fraccion_positiva"),
    )
