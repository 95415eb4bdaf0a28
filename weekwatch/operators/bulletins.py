"""Extraction of regional tables from bulletin texts, common parts.

Names are not searched one by one: every run of letters that is followed by
numbers is taken from the text, its endings are turned into place keys and
equi-joined with the region names. The work grows with the text, not with
text x names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.text import place_key

DOCUMENT = ("archivo", "anio", "semana_archivo", "version")
SPACES = r"[^\S\n]+"

# Cover words of holiday bulletins.
HOLIDAY = r"(?i)vacaciones|vigilancia\s+intensificada|semana\s+santa|fiestas\s+agostinas|fin\s+de\s+a[ñn]o"

# Diagnostic state -> stored state.
STORED_STATE = {
    "ok": "ok",
    "revision_manual": "revision_manual",
    "ausencia_esperada_vacacion": "ausencia_esperada",
    "ausencia_esperada_multisemana": "ausencia_esperada",
    "sin_texto_extraible": "sin_texto_extraible",
    "sin_tabla_no_vacacional": "revision_manual",
    "error_extraccion": "error",
    "ausencia_esperada": "ausencia_esperada",
}


def first_page(pages: DataFrame, keep: Column) -> DataFrame:
    """Text of the first page per document that passes ``keep``."""
    return pages.filter(keep).groupBy(*DOCUMENT).agg(
        F.min("pagina").alias("pagina"), F.min_by("texto", "pagina").alias("texto")
    )


def until(text: Column, markers: Sequence[str]) -> Column:
    """Text up to the first of the literal ``markers``, all of it when none occurs."""
    stop = "|".join(markers)
    return F.regexp_extract(text, rf"(?s)^(.*?)(?:{stop}|\z)", 1)


def named_rows(
    blocks: DataFrame, names: DataFrame, pattern: str, block: str = "bloque", by: Sequence[str] = ("archivo",)
) -> DataFrame:
    """Numbers that follow a region name, first occurrence per block and region.

    ``pattern`` has two groups: a run of letters and the numbers after it.
    ``names`` has (region, nombre); when names nest, the longest one wins. ``by``
    are the columns that identify a block and are kept.
    """
    keys = names.select("region", place_key(F.col("nombre")).alias("_clave"))
    longest = keys.agg(F.max(F.size(F.split("_clave", " ")))).scalar()
    matches = blocks.select(
        *by, F.posexplode(F.regexp_extract_all(block, F.lit(pattern), F.lit(0))).alias("_pos", "_hallado")
    )
    words = F.split(F.trim(F.regexp_extract("_hallado", f"^{pattern}$", 1)), r"\s+")
    parts = matches.select(
        *by, "_pos", words.alias("_palabras"), F.regexp_extract("_hallado", f"^{pattern}$", 2).alias("numeros")
    ).withColumn("_largo", F.least(F.size("_palabras"), longest))
    endings = parts.select(
        *by, "_pos", "_palabras", "numeros", F.explode(F.sequence(F.lit(1), F.col("_largo"))).alias("_n")
    )
    ending = F.array_join(F.slice("_palabras", -F.col("_n"), F.col("_n")), " ")
    found = endings.withColumn("_clave", place_key(ending)).join(keys, "_clave")
    per_match = found.groupBy(*by, "_pos").agg(F.max_by(F.struct("region", "numeros"), "_n").alias("f"))
    return per_match.groupBy(*by, F.col("f.region").alias("region")).agg(
        F.min_by("f.numeros", "_pos").alias("numeros")
    )


def numbers(text: Column) -> Column:
    """Array of the numbers in a whitespace-separated list with a decimal comma or point."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def state_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("anio", "estado").agg(F.count(F.lit(1)).alias("boletines"))


def apply_reviews(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Manual reviews by file name: their state replaces, their note is appended."""
    new = reviews.select("archivo", F.col("estado").alias("_estado"), F.col("nota").alias("_nota"))
    joined = documents.join(new, "archivo", "left")
    note = F.when(F.col("_nota").isNull(), F.col("nota")).otherwise(
        F.concat_ws(" | ", F.nullif("nota", F.lit("")), "_nota")
    )
    return joined.withColumns({"estado": F.coalesce("_estado", "estado"), "nota": note}).drop("_estado", "_nota")


def stored_state(state: Column) -> Column:
    pairs = [F.lit(x) for pair in STORED_STATE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), state)


def stored_week(label: Column) -> Column:
    """Week of a file name; combined weeks have none."""
    return F.when(~label.contains("-"), label.try_cast("int"))


def balance(table: Column, national: Column) -> Column:
    """True when either total agrees, false when both are known not to, else unknown."""
    return F.when(table | national, True).when(~table & ~national, False)


def reconciled(table: Column, national: Column) -> Column:
    """Three-valued OR that treats unknown as not agreeing."""
    return F.coalesce(table, F.lit(False)) | F.coalesce(national, F.lit(False))


def verify_known(documents: DataFrame, known: DataFrame, fields: Sequence[str], tolerance: float = 0.5) -> DataFrame:
    """Hand-checked values against extracted ones; fields that are null in ``known`` are not compared."""
    right = known.select("archivo", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = right.join(documents, "archivo", "left")
    agrees = F.lit(True)
    for f in fields:
        close = F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) < tolerance, F.lit(False))
        agrees = agrees & (F.col(f"_{f}").isNull() | close)
    return joined.select(
        "archivo",
        F.col("estado").isNotNull().alias("encontrado"),
        F.when(F.col("estado") == "ok", agrees).alias("coincide"),
    )
