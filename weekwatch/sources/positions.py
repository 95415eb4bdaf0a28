"""Reading order of text-like files, without passing a file through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_position() -> Column:
    """Sortable position of a row: file, block of the file, row within the block.

    Valid within one job; store the rows before comparing positions of two jobs.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
        F.monotonically_increasing_id().alias("fila"),
    )


def positioned(rows: DataFrame, name: str = "posicion") -> DataFrame:
    return rows.select("*", row_position().alias(name))
