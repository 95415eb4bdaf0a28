"""Corpus of extracted bulletin texts: a folder per year, a file per bulletin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.functions.text import file_version, file_week

PAGE_BREAK = "\f"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page; the year comes from the folder, week and version from the file name.

    A bulletin is a few pages of text, so one file per row is safe.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    full = F.url_decode(F.col("_metadata.file_path"))
    named = files.select(
        "value",
        F.regexp_extract(full, r"/(?:anio=)?(\d{4})/", 1).cast("int").alias("anio"),
        F.regexp_extract(full, r"/\d{4}/(?:archivo=)?([^/]+)|/anio=\d{4}/archivo=([^/]+)", 1).alias("_suelto"),
        F.regexp_extract(full, r"/anio=\d{4}/archivo=([^/]+)", 1).alias("_particion"),
    )
    name = F.when(F.col("_particion") != "", F.col("_particion")).otherwise(F.col("_suelto"))
    return (
        named.withColumn("archivo", name)
        .select(
            "archivo",
            "anio",
            file_week(F.col("archivo")).alias("semana_archivo"),
            file_version(F.col("archivo")).alias("version"),
            F.posexplode(F.split("value", PAGE_BREAK)).alias("pagina", "texto"),
        )
    )
