"""Result files and the fingerprint gate of frozen sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FingerprintMismatch(ValueError):
    """A source file is not the frozen one."""


def csv(df: DataFrame, path: str) -> None:
    """Flat CSV files with header; one file per partition, written in parallel."""
    df.write.mode("errorifexists").csv(path, header=True, emptyValue="")


def facts(df: DataFrame, path: str, partitions: Sequence[str] = ("anio",)) -> None:
    """Parquet fact partitioned by year; only the years in ``df`` are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per source file; a file is one row, so it must be under 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("archivo"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("carpeta"),
        F.sha2("content", 256).alias("sha256"),
    )


def require_fingerprints(spark: SparkSession, path: str, expected: Mapping[str, str]) -> None:
    """Raise unless every expected file is present with its frozen SHA-256."""
    found = {r["archivo"]: r["sha256"] for r in fingerprints(spark, path).filter(F.col("archivo").isin(*expected)).collect()}
    wrong = sorted(name for name, value in expected.items() if found.get(name) != value)
    if wrong:
        raise FingerprintMismatch(f"changed or missing sources: {wrong}")
