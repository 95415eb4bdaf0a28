"""Rows of one table inside a plain-text database dump."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.session import stored
from weekwatch.sources.positions import positioned

TERMINATOR = r"\."
NULL = r"\N"


class DumpError(ValueError):
    """The dump lacks a complete block for a table."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position, stored so that positions stay comparable."""
    return stored(positioned(spark.read.text(path)))


def block(dump: DataFrame, table: str) -> DataFrame:
    """Data lines of ``table``.

    Only the block limits reach the driver, two per table of the dump.
    """
    start = F.col("value").startswith(f"COPY public.{table} ")
    limits = dump.filter(start | (F.col("value") == TERMINATOR)).select("posicion", start.alias("abre")).collect()
    limits.sort(key=lambda r: tuple(r["posicion"]))
    opened = next((i for i, r in enumerate(limits) if r["abre"]), None)
    if opened is None or opened + 1 >= len(limits):
        raise DumpError(f"no complete block for {table}")
    first, last = limits[opened]["posicion"], limits[opened + 1]["posicion"]
    as_column = lambda p: F.struct(
        F.lit(p["archivo"]).alias("archivo"),
        F.lit(p["bloque"]).cast("bigint").alias("bloque"),
        F.lit(p["fila"]).cast("bigint").alias("fila"),
    )
    inside = (F.col("posicion") > as_column(first)) & (F.col("posicion") < as_column(last))
    return dump.filter(inside).select("value")


def table(dump: DataFrame, name: str, columns: Mapping[str, tuple[int, str]]) -> DataFrame:
    """Typed columns ``{name: (position, type)}``; values that do not cast become null."""
    fields = block(dump, name).select(F.split("value", "\t").alias("c"))
    return fields.select(
        *[
            F.nullif(F.get("c", F.lit(position)), F.lit(NULL)).try_cast(kind).alias(column)
            for column, (position, kind) in columns.items()
        ]
    )
