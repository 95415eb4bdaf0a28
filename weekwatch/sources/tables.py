"""Dimension files and re-reads of interim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION_SCHEMA = "codigo string, nombre string, nivel_admin int, pais string, padre string"


class SourceContractError(ValueError):
    """The file breaks a rule that must hold before any row is used."""


def by_name(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV columns picked by their header names, in any order and beside any others.

    A missing column aborts, as does a file whose header differs from the first one's. Values that are no number or
    date become null.
    """
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    fields = T.DataType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name not in rows.columns]
    if missing:
        raise SourceContractError(f"columns missing in {path}: {missing}")
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Region hierarchy with the name of each parent; an unknown parent aborts nothing but stays null."""
    rows = by_name(spark, path, REGION_SCHEMA)
    parents = rows.select(F.col("codigo").alias("padre"), F.col("nombre").alias("padre_nombre"))
    return rows.join(parents, "padre", "left")


def interim(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Interim CSV with an explicit schema, never inferred."""
    return by_name(spark, path, schema)
