"""Daily weather responses: one array of locations per file, parallel arrays per location."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwatch.operators import contracts
from weekwatch.operators.weekly import DAILY, guard_false_zero, to_long

# Names in the response and names of the stored variables.
VARIABLES: Mapping[str, str] = {
    "temperature_2m_max": "temp_max",
    "temperature_2m_min": "temp_min",
    "temperature_2m_mean": "temp_media",
    "relative_humidity_2m_mean": "humedad_relativa_media",
    "dew_point_2m_mean": "punto_rocio",
    "precipitation_sum": "precipitation_sum",
    "precipitation_hours": "precipitation_hours",
}

_DAILY = T.StructType(
    [T.StructField("time", T.ArrayType(T.StringType()))]
    + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in VARIABLES]
)
RESPONSE = T.ArrayType(
    T.StructType(
        [
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType()),
            T.StructField("elevation", T.DoubleType()),
            T.StructField("daily", _DAILY),
        ]
    )
)


def responses(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """One row per location: response i of a file belongs to location i of its request.

    ``locations`` has (lote, posicion, region); the request number is the ``lote``
    partition of the path. A response holds the locations one request may name, so
    a file is small. A response without location, a location without response,
    text that is no JSON and arrays of unequal length abort the job that reads them.
    """
    text = spark.read.text(path, wholetext=True)
    parsed = text.select("lote", F.posexplode_outer(F.from_json("value", RESPONSE)).alias("posicion", "r"))
    joined = parsed.join(locations, ["lote", "posicion"], "full")
    met = contracts.require(
        joined, F.col("r").isNotNull() & F.col("region").isNotNull(), contracts.named("response and location do not meet", ["lote", "posicion"]))
    return contracts.require(
        met.select("region", "r.*"), ~_ragged(), contracts.named("variables missing or of unequal length", ["region"]))


def elevations(rows: DataFrame) -> DataFrame:
    return rows.select("region", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "elevation")


def daily(rows: DataFrame) -> DataFrame:
    """One row per location and day with the stored variable names, nulls kept."""
    arrays = [F.col("daily.time").alias("time")] + [F.col(f"daily.{name}").alias(name) for name in VARIABLES]
    days = rows.select("region", F.explode(F.arrays_zip(*arrays)).alias("d"))
    wide = days.select(
        "region",
        F.col("d.time").cast("date").alias("fecha"),
        *[F.col(f"d.{name}").cast(DAILY).alias(stored) for name, stored in VARIABLES.items()],
    )
    return guard_false_zero(wide)


def points(rows: DataFrame) -> DataFrame:
    """One row per location, day and known variable."""
    return to_long(daily(rows), ["region", "fecha"], list(VARIABLES.values()))


def _ragged() -> Column:
    """True for a location that lacks a variable or whose arrays differ in length."""
    n = F.size("daily.time")
    bad = F.lit(False)
    for name in VARIABLES:
        bad = bad | F.coalesce(F.size(f"daily.{name}") != n, F.lit(True))
    return bad


def ragged(rows: DataFrame) -> DataFrame:
    """Locations that lack a variable or whose arrays differ in length."""
    return rows.filter(_ragged()).select("region")
