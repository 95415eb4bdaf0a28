"""Lookups between facts and dimensions, with their completeness rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.text import place_key


class UnmatchedRows(RuntimeError):
    """Rows that must all resolve against a dimension did not."""


def by_place_name(rows: DataFrame, dim: DataFrame, name: str, dim_name: str = "nombre") -> DataFrame:
    """Left join on the normalised place name; unmatched rows keep a null dimension."""
    right = dim.withColumn("_lugar", place_key(F.col(dim_name)))
    return rows.withColumn("_lugar", place_key(F.col(name))).join(right, "_lugar", "left").drop("_lugar")


def name_match_report(rows: DataFrame, dim: DataFrame, name: str, dim_name: str = "nombre") -> DataFrame:
    """One row: distinct names, unmatched names, dimension rows reached and expected."""
    seen = rows.select(place_key(F.col(name)).alias("lugar")).distinct().withColumn("visto", F.lit(1))
    known = dim.select(place_key(F.col(dim_name)).alias("lugar"), F.lit(1).alias("hay"))
    return seen.join(known, "lugar", "full").agg(
        F.count("visto").alias("nombres"),
        F.count_if(F.col("hay").isNull()).alias("sin_pareja"),
        F.count_if(F.col("visto").isNotNull() & F.col("hay").isNotNull()).alias("encontradas"),
        F.count("hay").alias("esperadas"),
    )


def require_match(rows: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that raises when any row has no partner, before anything is written."""
    missing = rows.join(dim.select(*on), list(on), "left_anti").select(*on).limit(5).collect()
    if missing:
        raise UnmatchedRows(f"no partner for {[row.asDict() for row in missing]}")
    return rows.join(dim, list(on))


def require_all(dim: DataFrame, rows: DataFrame, on: Sequence[str]) -> None:
    """Raise when a dimension row is never used by ``rows``."""
    require_match(dim.select(*on), rows.select(*on).distinct(), on)


def keep_left(dim: DataFrame, fact: DataFrame, on: Sequence[str], keep: Column) -> DataFrame:
    """Left join whose fact filter belongs to the join condition, so every dim row survives."""
    return dim.join(fact.filter(keep), list(on), "left")


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Inner equi-joins of a fact with its catalogues.

    Catalogues (regions, events, sources, calendar) have one row per code, so
    Spark broadcasts them when they are under its threshold and shuffles otherwise.
    """
    for dim, on in dims:
        fact = fact.join(dim, list(on))
    return fact


def missing_keys(rows: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``rows`` that ``present`` lacks."""
    return rows.select(*on).distinct().join(present.select(*on), list(on), "left_anti")
