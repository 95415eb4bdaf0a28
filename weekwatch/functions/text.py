"""Text helpers for bulletin extracts and place names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters of the source language and their plain forms.
ACCENTED = "áéíóúüñàèìòùâêîôûäëïöçÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇ"
PLAIN = "aeiouunaeiouaeiouaeiocAEIOUUNAEIOUAEIOUAEIOC"
PLACE_PREFIX = r"^(?i)departamento\s+de\s+"


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def place_key(name: Column) -> Column:
    """Join key of a place name: no prefix, accents, case or repeated spaces."""
    bare = F.regexp_replace(F.trim(name), PLACE_PREFIX, "")
    return F.regexp_replace(F.trim(F.lower(strip_accents(bare))), r"\s+", " ")


def number(token: Column) -> Column:
    """Number with either thousands separator, or a short decimal.

    Groups of exactly three digits after every separator are thousands (also when
    the first separator was lost, as in ``1363,652``); otherwise the separator is
    the decimal mark. Tokens that are not numbers give null.
    """
    token = F.trim(token)
    thousands = token.rlike(r"^\d+(?:[.,]\d{3})+$")
    return F.when(thousands, F.regexp_replace(token, "[.,]", "").try_cast("double")).otherwise(
        F.replace(token, F.lit(","), F.lit(".")).try_cast("double")
    )


def file_week(name: Column) -> Column:
    """Week label in a file name: ``05`` as printed, ``1-2`` for combined weeks, else null."""
    first = F.regexp_extract(name, r"(?i)SE(\d{1,2})(?:-(\d{1,2}))?", 1)
    second = F.regexp_extract(name, r"(?i)SE(\d{1,2})(?:-(\d{1,2}))?", 2)
    joined = F.concat_ws("-", first.try_cast("int").cast("string"), second.try_cast("int").cast("string"))
    return F.when(first == "", F.lit(None).cast("string")).when(second == "", first).otherwise(joined)


def file_version(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(?i)_v(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(1))
