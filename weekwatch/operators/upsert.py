"""Idempotent writes over plain tables.

Winners are picked with ``max_by``, which combines on the map side: a key with
very many copies is reduced before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    others = [c for c in rows.columns if c not in keys]
    winner = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(winner.alias("_fila")).select(*keys, "_fila.*").select(*rows.columns)


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union of table and batch where the batch row wins; same columns in both.

    Of several batch rows with one key the greatest in ``order`` wins, and of equal ones the greatest in its values, so
    the result does not depend on how rows are dealt out.
    """
    both = table.withColumn("_lote", F.lit(0)).unionByName(batch.withColumn("_lote", F.lit(1)))
    values = [c for c in table.columns if c not in keys and c not in order]
    return last_wins(both, keys, ["_lote", *order, *values]).drop("_lote")


def insert_absent(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table plus the batch rows whose key it does not hold."""
    return table.unionByName(batch.join(table.select(*keys), list(keys), "left_anti"))


def update_attributes(dim: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Dimension with new attribute values where ``updates`` has them."""
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = dim.join(new, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*dim.columns)


def stable_id(name: Column) -> Column:
    """Row id that depends only on the natural key, so reloads keep the lineage."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def audit_log(log: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Upsert of processed bulletins on their file name, with the id facts refer to."""
    merged = upsert(log, bulletins, ["archivo"])
    return merged.withColumn("boletin_id", stable_id(F.col("archivo")))
