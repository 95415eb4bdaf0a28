"""Class assignment from cuts. Equality with a cut always falls to the lower class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class, zone and category names of the published scheme.
CLASSES = ("bajo", "medio", "alto")
ZONES = ("exito", "seguridad", "alarma", "epidemia")
PRESSURE = ("baja", "media", "alta")
ZONE_TO_CLASS = {"exito": "bajo", "seguridad": "bajo", "alarma": "medio", "epidemia": "alto"}

# Symmetric breaks of the standardised anomaly legend.
ANOMALY_BREAKS = (-1.5, -0.5, 0.5, 1.5)


def two_cuts(value: Column, lower: Column, upper: Column, names: Sequence[str] = CLASSES) -> Column:
    """Three classes by two cuts; null when the cuts are null."""
    low, mid, high = names
    return F.when(value > upper, high).when(value > lower, mid).when(upper.isNotNull() & value.isNotNull(), low)


def four_zones(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    success, safety, alarm, epidemic = ZONES
    return (
        F.when(value > p75, epidemic)
        .when(value > p50, alarm)
        .when(value > p25, safety)
        .when(p75.isNotNull() & value.isNotNull(), success)
    )


def by_map(key: Column, mapping: Mapping[str, str]) -> Column:
    """Explicit lookup; keys outside the mapping give null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def first_break(value: Column, breaks: Sequence[Column | float]) -> Column:
    """Index of the first break that is >= value; one more than the last index above all."""
    chain = F.when(value.isNull(), F.lit(None).cast("int"))
    for index, cut in enumerate(breaks):
        chain = chain.when(value <= cut, F.lit(index))
    return chain.otherwise(F.lit(len(breaks)))
