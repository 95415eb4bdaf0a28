"""Bulletin texts printed from the cumulative counters, with the defects real ones have.

The texts stand for the extracted pages of published bulletins, so the
extraction can be checked against the counters they were printed from. A
bulletin holds one line per region of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwatch.functions.text import file_version, file_week, strip_accents
from weekwatch.plans import adapters as A

# Column names rather than columns: importing must not need a session.
WEEK, YEAR = "semana", "anio"


def _printed_name() -> Column:
    """Early years print names without accents."""
    return F.when(F.col(YEAR) < 1998, strip_accents(F.col("nombre"))).otherwise(F.col("nombre"))


def _is(modulus: int, rest: int) -> Column:
    return F.col(WEEK) % modulus == rest


def _documents(lines: DataFrame) -> DataFrame:
    """Lines of one bulletin joined in region order, with the sums the totals need."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("region", "linea"))), lambda x: x["linea"])
    sums = [F.sum(c).alias(c) for c in ("p", "c") if c in lines.columns]
    return lines.groupBy("archivo", "anio", "semana", "version").agg(F.array_join(ordered, "\n").alias("tabla"), *sums)


def _pages(documents: DataFrame, parts: list[Column]) -> DataFrame:
    texts = F.array_compact(F.array(*parts))
    name = F.col("archivo")
    return documents.select(
        "archivo", "anio", file_week(name).alias("semana_archivo"), file_version(name).alias("version"),
        F.posexplode(texts).alias("pagina", "texto"),
    )


def _cover() -> Column:
    plain = F.format_string("Boletin epidemiologico\nSemana %d de %d", WEEK, YEAR)
    return F.when(_is(13, 0), F.concat(plain, F.lit("\nVigilancia  intensificada por Semana Santa"))).otherwise(plain)


def laboratory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the probable and confirmed counters of every region."""
    cuts = A.cuts(spark, sf_dir).filter(F.col("clase").isin("probable", "confirmado"))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("clase") == c, F.col("acum"))), F.lit(0))
    wide = cuts.groupBy("archivo", "anio", "semana", "version", "region").agg(
        pick("probable").alias("p"), pick("confirmado").alias("c")
    )
    named = wide.join(A.regions(spark, sf_dir).select("region", "nombre"), "region")
    shown = named.filter(~(_is(11, 10) & (F.col("region") == 3)))
    rate = F.when(F.col(YEAR) <= 1997, F.format_string(" %.1f", F.col("p") / F.lit(7.0))).otherwise("")
    noise = (F.col("region") + F.col(WEEK)) % 9 == 0
    blank = (F.col("p") == 0) & ((F.col("region") + F.col(WEEK)) % 5 == 0) & ~noise
    first = F.when(blank, "").otherwise(F.concat(F.lit(" "), F.col("p").cast("string")))
    line = F.concat(
        _printed_name(), first, F.lit(" "), F.col("c").cast("string"), rate, F.when(noise, " 21 casos.").otherwise("")
    )
    documents = _documents(shown.withColumn("linea", line))

    weeks = F.when(_is(21, 8), "").otherwise(F.format_string(", SE %02d y SE %02d", WEEK, WEEK))
    title = F.when(
        (F.col(YEAR) <= 1997) & ~_is(21, 8),
        F.format_string("Casos probables de dengue SE %d y casos confirmados de dengue SE %d, por departamento", WEEK, WEEK),
    ).otherwise(F.concat(F.lit("Casos probables y confirmados de dengue segun departamento"), weeks))
    header = F.concat(
        F.when(_is(22, 2), F.format_string("SE1-%d ", WEEK)).otherwise(""),
        F.lit("Probables Confirmados"),
        F.when(F.col(YEAR) <= 1997, " Tasa x 100,000").otherwise(""),
    )
    extra = F.when(_is(10, 7), 1).otherwise(0)
    error = F.when(_is(23, 20), 5).otherwise(0)
    total = F.format_string("Total %d %d", F.col("p") + 2 * extra + error, F.col("c") + extra)
    page = F.concat_ws(
        "\n", title, header, "tabla", F.lit("Otros países 2 1"), total,
        F.lit("Índices larvarios por departamento"), F.lit("África AA 99 99"),
    )
    absent = _is(13, 0) | _is(16, 15) | _is(19, 14)
    summary = F.when(_is(16, 15) & ~_is(13, 0), "Resumen general").otherwise("Resumen: dengue, zika y chikungunya")
    return _pages(documents, [_cover(), summary, F.when(~absent, page)])


def notified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the notified counter of every region and a table of another disease before it."""
    cuts = A.cuts(spark, sf_dir).filter(F.col("clase") == "notificado").withColumnRenamed("acum", "p")
    named = cuts.join(A.regions(spark, sf_dir).select("region", "nombre"), "region")
    shown = named.filter(~(_is(11, 10) & (F.col("region") == 3)))
    beside = F.when(_beside() & (F.col("region") % 3 == 0), "<1 año 4,905 4,407 ").otherwise("")
    line = F.concat(beside, _printed_name(), F.lit(" "), _thousands(F.col("p") * 1000), F.lit(" 12.5"))
    documents = _documents(shown.withColumn("linea", line))

    shift = F.when(_is(17, 16), 1).otherwise(0)
    week = F.col(WEEK) - shift
    untitled = _is(23, 22)
    title = (
        F.when(untitled, F.lit("IRA"))
        .when(_is(3, 0) & ~_beside(), F.format_string("Casos y tasas por departamento de IRA, El Salvador, SE %d %d", week, YEAR))
        .when(_is(3, 0), F.format_string("Casos y tasas por grupo de edad y departamento de IRAS, El Salvador, SE01-%02d %d", week, YEAR))
        .when(_is(3, 2), F.format_string("Infección respiratoria aguda, El Salvador, SE %d-%d", week, YEAR))
        .otherwise(F.lit("IRAS"))
    )
    delta = F.when(_is(7, 3), 1).when(_is(9, 5), 50).otherwise(0)
    with_others = _is(5, 2)
    total = F.col("p") * 1000
    rows = F.when(_is(20, 3), F.lit("(imagen)")).otherwise(
        F.concat_ws(
            "\n", "tabla",
            F.when(with_others, F.lit("Otros Países 4")),
            F.concat(F.lit("Total general "), _thousands(total + 90000)),
            F.concat(F.lit("Total general "), _thousands(total + delta + F.when(with_others, 4).otherwise(0))),
        )
    )
    foot = F.when(
        ~untitled & _is(3, 1),
        F.format_string("Estratificación de riesgo de infecciones respiratorias agudas, El Salvador SE %d, %d.", week, YEAR),
    ).otherwise(F.lit("Estratificación de riesgo"))
    page = F.concat_ws("\n", title, F.lit("Departamento Total general Tasa"), rows, foot)
    other = F.concat_ws("\n", F.lit("IRA y dengue"), "tabla")
    absent = _is(13, 0) | _is(16, 15) | _is(19, 14)
    summary = F.when(_is(16, 15) & ~_is(13, 0), F.lit("Resumen general")).when(absent, F.lit("Resumen de IRA")).otherwise(other)
    return _pages(documents, [_cover(), summary, F.when(~absent, page)])


def _beside() -> Column:
    return F.col(WEEK) % 4 == 1


def _thousands(value: Column) -> Column:
    comma = F.format_number(value, 0)
    return F.when(F.col(YEAR) % 2 == 0, F.replace(comma, F.lit(","), F.lit("."))).otherwise(comma)
