"""Lead time of the national alert: suitability of the weeks every region has, against the national season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from weekwatch.operators import anomaly, channel, season, weekly


def national(
    suitability: DataFrame, n_regions: Column | int, cases: DataFrame, corpus: Sequence[int], base_years: Sequence[int], threshold: float = 1.5
) -> DataFrame:
    """Per year: first national alert, real season start, and the weeks between them.

    ``suitability`` is (region, anio, semana, iv), ``cases`` the national (anio, semana, valor). An index that does not vary
    over the corpus aborts. A start in week 1 counts as any other.
    """
    checked = anomaly.require_variation(suitability, "iv")
    common = weekly.common_to_all(checked, "region", n_regions, "iv")
    alerts = season.first_alert(anomaly.same_week_anomaly(common, [], "iv", corpus), [], threshold)
    starts = season.season_start(channel.endemic_channel(cases, [], base_years), [], require_sufficient=True)
    return season.lead_time(starts, alerts, [], first_week_unreliable=False)
