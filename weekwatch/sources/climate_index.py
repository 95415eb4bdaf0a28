"""Monthly climate index published as whitespace-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Three-month season code -> its central month.
CENTRAL_MONTH = {
    "DJF": 1, "JFM": 2, "FMA": 3, "MAM": 4, "AMJ": 5, "MJJ": 6,
    "JJA": 7, "JAS": 8, "ASO": 9, "SON": 10, "OND": 11, "NDJ": 12,
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(anio, mes, anom); the header and lines that do not have four fields are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    months = F.create_map(*[F.lit(x) for pair in CENTRAL_MONTH.items() for x in pair])
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 4)
    return rows.select(
        F.get("p", F.lit(1)).try_cast("int").alias("anio"),
        F.try_element_at(months, F.get("p", F.lit(0))).alias("mes"),
        F.get("p", F.lit(3)).try_cast("double").alias("anom"),
    ).dropna()
