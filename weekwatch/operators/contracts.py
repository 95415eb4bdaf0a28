"""Conditions that abort a job, carried by its rows.

A contract is an expression of the plan: nothing is collected before the job, and the job that writes the rows is the
one that fails. What a broken contract names comes from the first offending row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(rows: DataFrame, holds: Column, message: Column | str) -> DataFrame:
    """The same rows; the job aborts at a row for which ``holds`` is false or unknown.

    The term on the partition is always true. It keeps the optimizer from merging later filters into this one, whose
    constants would then stand in the condition and let offending rows go unseen.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return rows.filter(F.when(F.coalesce(holds, F.lit(False)), F.spark_partition_id() >= 0).otherwise(F.raise_error(text).cast("boolean")))


def named(what: str, columns: Sequence[str]) -> Column:
    """Message with the values of ``columns``."""
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]
    return F.concat(F.lit(f"{what}: "), F.concat_ws(", ", *values))


def matched(rows: DataFrame, dim: DataFrame, on: Sequence[str], what: str = "no partner") -> DataFrame:
    """Inner join with a catalogue in which every row must have a partner."""
    known = dim.withColumn("_pareja", F.lit(True))
    return require(rows.join(known, list(on), "left"), F.col("_pareja").isNotNull(), named(what, on)).drop("_pareja")


def without(rows: DataFrame, offences: DataFrame, message: Column | str) -> DataFrame:
    """The same rows; the job aborts when ``offences`` has any, also when ``rows`` has none."""
    stopped = require(offences, F.lit(False), message)
    return rows.unionByName(stopped.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def unique(rows: DataFrame, keys: Sequence[str], what: str = "repeated key") -> DataFrame:
    """The same rows, each key of which must occur once."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_filas"), F.first(F.struct(*[F.col(c) for c in others])).alias("_otras"))
    return require(one, F.col("_filas") == 1, named(what, keys)).select(*keys, *[F.col("_otras")[c].alias(c) for c in others])
