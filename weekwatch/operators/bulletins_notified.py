"""Bulletins with a single notified count per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.text import number
from weekwatch.operators import bulletins as B
from weekwatch.operators import cumulative
from weekwatch.session import stored

# Marks, titles and end marks of the printed table.
NUMBER = r"(?:\d+(?:[.,]\d{3})+|\d+(?:[.,]\d{1,2})?)"
MARK = r"\bIRAS?\b|[Rr]espiratorias?\s+[Aa]gudas?|Infecci[oó]n\s+[Rr]espiratoria"
OTHER_DISEASE = r"(?i)dengue|zika|chikungun|neumon[ií]a|diarreica|rotavirus|IRAG|aguda\s+grave"
_WEEK = r"SE\s*-?\s*0?(\d{1,2})(?:\s*-\s*(\d{1,2})\b(?!\d))?[\s,.-]*(?:de\s+)?(\d{4})"
TITLE = (
    r"(?s)(?:Casos\s+y\s+[Tt]asas\s+por\s+(?:grupo\s+de\s+edad\s+y\s+)?[Dd]epartamento\s+de\s+IRAS?\b"
    r"|Casos\s+y\s+[Tt]asas\s+de\s+IRAS?\s+por\s+grupo\s+de\s+edad\s+y\s+departamento\b).{0,60}?" + _WEEK
)
FOOTNOTE = (
    r"(?s)infecciones\s+respiratorias\s+agudas.{0,40}?SE\s*(\d{1,2})(?:\s*-\s*(\d{1,2})\b(?!\d))?[\s,.-]*(\d{4})"
)
SECTION = (
    r"(?s)[Ii]nfecci[oó]n(?:es)?\s+respiratorias?\s+agudas?(?:\s*\(IRA\))?[\s,]+El\s+Salvador[\s,]+" + _WEEK
)
HEADER = r"(?:Departamentos?|Grupos?\s+de\s+[Ee]dad)\s+Total(?:\s+general)?\s+Tasa"
ROW = rf"(\p{{L}}[\p{{L}} ]*?){B.SPACES}({NUMBER}(?:{B.SPACES}{NUMBER})?)"
OTHER = rf"Otros\s+[Pp]a[ií]ses{B.SPACES}({NUMBER})"
TOTAL = rf"Total(?:{B.SPACES}general)?{B.SPACES}({NUMBER})"
END_MARKS = ("Estratificación", "Estratificacion", "Ministerio de Salud / Dirección", "Ministerio de Salud / Direccion")
SOURCES = (("titulo_tabla", TITLE), ("pie_estratificacion", FOOTNOTE), ("titulo_seccion", SECTION))
USABLE = ("ok", "ok_discrepancia_minima")


def cut_week(text: Column) -> tuple[Column, Column]:
    """Cut week and where it was read: table title, foot note or section title, in order of trust.

    A range ends in the cut week.
    """
    week, source = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, pattern in reversed(SOURCES):
        found = text.rlike(pattern)
        printed = F.coalesce(
            F.regexp_extract(text, pattern, 2).try_cast("int"), F.regexp_extract(text, pattern, 1).try_cast("int")
        )
        week = F.when(found, printed).otherwise(week)
        source = F.when(found, name).otherwise(source)
    return week, source


def layout(text: Column) -> Column:
    title = F.lower(F.regexp_extract(text, f"({TITLE})", 1))
    return F.when(title.contains("grupo de edad"), "lado_a_lado").otherwise("pagina_propia")


def block(text: Column) -> Column:
    """From the table title, else from the column header, else the whole page."""
    after_title = F.regexp_extract(text, rf"{TITLE}(.*)\z", 4)
    from_header = F.regexp_extract(text, rf"(?s)({HEADER}.*)\z", 1)
    body = (
        F.when(text.rlike(TITLE), after_title).when(text.rlike(HEADER), from_header).otherwise(text)
    )
    return B.until(body, END_MARKS)


def table_pages(pages: DataFrame, names: DataFrame, min_rows: int = 10) -> DataFrame:
    """Table page per document: marked, with enough region rows and not of another disease.

    A page with the title but without rows is kept as a table printed as an image,
    unless a page with rows exists.
    """
    marked = pages.filter(F.col("texto").rlike(MARK)).withColumns(
        {
            "_titulo": F.col("texto").rlike(TITLE) | F.col("texto").rlike(FOOTNOTE),
            "_otra": F.col("texto").rlike(OTHER_DISEASE),
        }
    )
    counted = (
        B.named_rows(marked, names, ROW, "texto", by=["archivo", "pagina"])
        .groupBy("archivo", "pagina")
        .agg(F.count(F.lit(1)).alias("_filas"))
    )
    judged = marked.join(counted, ["archivo", "pagina"], "left").withColumn("_filas", F.coalesce("_filas", F.lit(0)))
    full = F.col("_filas") >= min_rows
    rank = F.when(full & (F.col("_titulo") | ~F.col("_otra")), 0).when(F.col("_titulo") & ~full, 1)
    best = judged.withColumn("_rango", rank).filter(F.col("_rango").isNotNull())
    located = best.groupBy(*B.DOCUMENT).agg(
        F.min_by(F.struct("pagina", "texto"), F.struct("_rango", "pagina")).alias("f")
    ).select(*B.DOCUMENT, F.col("f.pagina").alias("pagina"), F.col("f.texto").alias("texto"))
    week, source = cut_week(F.col("texto"))
    return located.select(
        *B.DOCUMENT,
        "pagina",
        block(F.col("texto")).alias("bloque"),
        layout(F.col("texto")).alias("disposicion"),
        week.alias("semana_corte"),
        source.alias("fuente_semana"),
    )


def rows(tables: DataFrame, names: DataFrame) -> DataFrame:
    """Total and rate per document and region."""
    found = B.named_rows(tables, names, ROW)
    tokens = F.split(F.trim("numeros"), r"\s+")
    return found.select(
        "archivo", "region", number(F.get(tokens, F.lit(0))).alias("total"), number(F.get(tokens, F.lit(1))).alias("tasa")
    )


def nearest_total(sum_: Column, other: Column, totals: Column) -> Column:
    """Struct (distancia, diferencia, total) of the printed total nearest to the sum.

    Every printed total is tried with and without the other countries.
    """
    candidates = F.array_compact(F.array(sum_, sum_ + other))
    pairs = F.flatten(
        F.transform(
            totals,
            lambda t: F.transform(
                candidates,
                lambda c: F.struct(
                    F.abs(c - t).alias("distancia"), (c - t).alias("diferencia"), t.alias("total")
                ),
            ),
        )
    )
    return F.array_min(pairs)


def state_without_table(pages: DataFrame) -> DataFrame:
    documents = pages.groupBy(*B.DOCUMENT).agg(
        F.bool_or((F.col("pagina") == 0) & F.col("texto").rlike(B.HOLIDAY)).alias("_vacacion"),
        F.bool_or(F.col("texto").rlike(MARK)).alias("_menciona"),
    )
    state = (
        F.when(F.col("_vacacion"), "ausencia_esperada_vacacion")
        .when(~F.col("_menciona"), "sin_texto_extraible")
        .otherwise("sin_tabla_ira")
    )
    return documents.select(*B.DOCUMENT, state.alias("_estado_sin"))


def analyse(pages: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with state and figures, and the regional rows of all tables found.

    Located tables, one page per document, are stored once: rows and figures both read them.
    """
    tables = stored(table_pages(pages, names))
    found = rows(tables, names)
    sums = found.groupBy("archivo").agg(F.count(F.lit(1)).alias("n_filas"), F.sum("total").alias("suma"))
    printed = F.transform(F.regexp_extract_all("bloque", F.lit(TOTAL), F.lit(1)), number)
    other = number(F.nullif(F.regexp_extract("bloque", OTHER, 1), F.lit("")))
    figures = (
        tables.withColumns({"otros": other, "totales": printed})
        .join(sums, "archivo", "left")
        .fillna(0, ["n_filas"])
        .withColumns({"_cercano": nearest_total(F.col("suma"), F.col("otros"), F.col("totales")), "_esperadas": names.agg(F.count(F.lit(1))).scalar()})
        .drop("bloque")
    )
    joined = state_without_table(pages).join(figures, list(B.DOCUMENT), "left")
    distance = F.col("_cercano.distancia")
    mismatch = distance >= 0.5
    simple = F.col("semana_archivo").isNotNull() & ~F.col("semana_archivo").contains("-")
    other_week = simple & (F.col("semana_corte") != F.col("semana_archivo").try_cast("int"))
    accepted = F.when(F.coalesce(mismatch, F.lit(False)), "ok_discrepancia_minima").otherwise("ok")
    state = (
        F.when(F.col("pagina").isNull(), F.col("_estado_sin"))
        .when(F.col("n_filas") == 0, "sin_filas_sospecha_imagen")
        .when(F.col("n_filas") < F.col("_esperadas"), "error_extraccion")
        .when(mismatch & (distance > 3), "revision_manual")
        .when(F.col("semana_corte").isNull() & ~F.coalesce(mismatch, F.lit(False)), "revision_manual")
        .when(F.coalesce(other_week, F.lit(False)), "revision_manual")
        .otherwise(accepted)
    )
    note = (
        F.when(F.col("pagina").isNull(), "sin tabla")
        .when(F.col("n_filas") == 0, "tabla sin filas legibles")
        .when(F.col("n_filas") < F.col("_esperadas"), F.format_string("faltan lugares: %d de %d", "n_filas", "_esperadas"))
        .when(mismatch, F.format_string("la suma difiere del total: %s", F.col("_cercano.diferencia").cast("string")))
        .when(F.col("semana_corte").isNull(), "sin semana de corte")
        .when(F.coalesce(other_week, F.lit(False)), "semana de corte distinta de la del archivo")
        .otherwise("")
    )
    documents = joined.select(
        *B.DOCUMENT,
        state.alias("estado"),
        note.alias("nota"),
        "disposicion",
        "semana_corte",
        "fuente_semana",
        "n_filas",
        "suma",
        "otros",
        F.col("_cercano.total").alias("total_impreso"),
        F.col("_cercano.diferencia").alias("diferencia"),
    )
    return documents, found


def current(documents: DataFrame) -> DataFrame:
    """Documents that no later version of their week replaces."""
    return cumulative.resolve_versions(documents.withColumnRenamed("nota", "_nota")).filter("vigente").drop("vigente", "nota").withColumnRenamed(
        "_nota", "nota")


def review_reprints(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents in which every usable table that repeats the one before it in the year is up for manual review.

    Counters of such a week would give a week without cases and then a double one. A repeated table is compared with its
    predecessor even when that one repeats another.
    """
    again = cumulative.reprints(cuts(documents, found), bulletin=["archivo"]).select(
        "archivo", F.format_string("la tabla repite la del corte SE%d (%s)", "previa", "previa_archivo").alias("_repite"))
    marked = documents.join(again, "archivo", "left")
    repeated = F.col("_repite").isNotNull()
    return marked.withColumns({
        "estado": F.when(repeated, "revision_manual").otherwise(F.col("estado")),
        "nota": F.when(repeated, F.col("_repite")).otherwise(F.col("nota")),
    }).select(*documents.columns)


def cuts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Cumulative counters of usable bulletins."""
    usable = documents.filter(F.col("estado").isin(*USABLE) & F.col("semana_corte").isNotNull())
    return found.join(usable.select("archivo", "anio", F.col("semana_corte").alias("semana")), "archivo").select(
        "archivo", "anio", "region", "semana", F.col("total").alias("acum")
    )
