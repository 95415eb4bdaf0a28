"""Thermal, rain and humidity suitability formulas and their weekly derivatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published suitability index.
T_MIN, T_MAX = 16.0, 38.0
RAIN_CENTRE, RAIN_SLOPE = 30.0, 0.1
HUMIDITY_FULL = 50.0
RAIN_FLOOR, RAIN_SPAN = 0.3, 0.7

# Fixed values of the mechanistic predictors (degrees Celsius, per cent).
TRANSMISSION_MIN, TRANSMISSION_MAX = 17.8, 34.6
DEVELOPMENT_BASE, DEVELOPMENT_TOP = 16.0, 35.0
OPTIMUM_MIN, OPTIMUM_MAX, OPTIMUM_HUMIDITY = 27.0, 29.5, 75.0


def _raw_thermal(t: float) -> float:
    return t * (t - T_MIN) * max(0.0, T_MAX - t) ** 0.5


def _grid_peak(step: float = 0.001) -> float:
    """Largest raw thermal value on the accumulated grid from T_MIN to T_MAX."""
    peak, t = 0.0, T_MIN
    while t <= T_MAX:
        peak = max(peak, _raw_thermal(t))
        t += step
    return peak


THERMAL_SCALE = 1.0 / _grid_peak()


def thermal(temperature: Column) -> Column:
    inside = (temperature > T_MIN) & (temperature < T_MAX)
    raw = temperature * (temperature - T_MIN) * F.sqrt(F.greatest(F.lit(T_MAX) - temperature, F.lit(0.0)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(THERMAL_SCALE) * raw))
    return F.when(inside, clamped).when(temperature.isNotNull(), F.lit(0.0))


def rain(two_week_sum: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-RAIN_SLOPE) * (two_week_sum - RAIN_CENTRE)))


def humidity(relative: Column) -> Column:
    return F.when(
        relative.isNotNull(),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), relative / HUMIDITY_FULL)),
    )


def index(temperature: Column, two_week_sum: Column, relative: Column) -> Column:
    return (
        thermal(temperature)
        * (F.lit(RAIN_FLOOR) + F.lit(RAIN_SPAN) * rain(two_week_sum))
        * humidity(relative)
    )


def degree_days(temperature: Column) -> Column:
    """Weekly development degree-days of one mean temperature."""
    capped = F.least(temperature, F.lit(DEVELOPMENT_TOP))
    return F.lit(7.0) * F.greatest(capped - DEVELOPMENT_BASE, F.lit(0.0))


def moist_heat(temperature: Column, relative: Column) -> Column:
    excess = F.greatest(F.least(temperature, F.lit(TRANSMISSION_MAX)) - TRANSMISSION_MIN, F.lit(0.0))
    return F.when(temperature > TRANSMISSION_MAX, F.lit(0.0)).otherwise(excess * relative / 100.0)


def optimum(temperature: Column, relative: Column) -> Column:
    return (temperature >= OPTIMUM_MIN) & (temperature <= OPTIMUM_MAX) & (relative > OPTIMUM_HUMIDITY)


def transmits(temperature: Column) -> Column:
    return (temperature >= TRANSMISSION_MIN) & (temperature <= TRANSMISSION_MAX)
