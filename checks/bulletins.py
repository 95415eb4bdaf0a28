"""Bulletin extraction: printed texts must give back the counters they were printed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import check, view
from weekwatch.operators import bulletins as B
from weekwatch.operators import bulletins_lab as L
from weekwatch.operators import bulletins_notified as N
from weekwatch.operators import cumulative
from weekwatch.plans import adapters as A
from weekwatch.plans import bulletin_texts, notified_event
from weekwatch.session import new_path, stored
from weekwatch.sources import bulletin_files


def names(spark, d):
    return A.regions(spark, d).select("region", "nombre")


def lab_pages(spark, d):
    return stored(bulletin_texts.laboratory_pages(spark, d))


def lab(spark, d):
    return L.analyse(lab_pages(spark, d), names(spark, d))


view(
    "lab_filas",
    """SELECT archivo, anio, semana, version, region, coalesce(max(acum) FILTER (clase = 'probable'), 0) AS p,
        coalesce(max(acum) FILTER (clase = 'confirmado'), 0) AS c,
        NOT (semana % 13 = 0 OR semana % 16 = 15 OR semana % 19 = 14) AS hay_tabla, anio <= 1997 AS con_tasa
    FROM cuts WHERE clase <> 'notificado' AND NOT (semana % 11 = 10 AND region = 3) GROUP BY ALL""",
)
view(
    "lab_docs",
    """SELECT *, CASE WHEN semana % 13 = 0 THEN 'ausencia_esperada_vacacion' WHEN semana % 16 = 15 THEN 'sin_texto_extraible'
            WHEN NOT hay_tabla THEN 'sin_tabla_no_vacacional' WHEN n_filas < (SELECT count(*) FROM nation) THEN 'error_extraccion'
            WHEN semana % 22 = 2 THEN 'ausencia_esperada_multisemana' WHEN semana % 23 = 20 OR semana % 21 = 8 THEN 'revision_manual' ELSE 'ok' END AS estado
    FROM (SELECT *, sp + CASE WHEN semana % 10 = 7 THEN 2 ELSE 0 END + CASE WHEN semana % 23 = 20 THEN 5 ELSE 0 END AS tp,
            sc + CASE WHEN semana % 10 = 7 THEN 1 ELSE 0 END AS tc
          FROM (SELECT archivo, anio, semana, version, hay_tabla, con_tasa, count(*) AS n_filas, sum(p)::DOUBLE AS sp, sum(c)::DOUBLE AS sc
                FROM lab_filas GROUP BY ALL))""",
)

view(
    "not_filas",
    """SELECT archivo, anio, semana, version, region, acum * 1000 AS p, NOT (semana % 13 = 0 OR semana % 16 = 15 OR semana % 19 = 14) AS hay_tabla
    FROM cuts WHERE clase = 'notificado' AND NOT (semana % 11 = 10 AND region = 3)""",
)
view(
    "not_docs",
    """SELECT *, CASE WHEN semana % 13 = 0 THEN 'ausencia_esperada_vacacion' WHEN semana % 16 = 15 THEN 'sin_texto_extraible' WHEN NOT hay_tabla THEN 'sin_tabla_ira'
            WHEN semana % 20 = 3 AND semana % 3 <> 1 AND (semana % 3 <> 0 OR semana % 23 = 22) THEN 'sin_tabla_ira'
            WHEN semana % 20 = 3 THEN 'sin_filas_sospecha_imagen' WHEN n_filas < (SELECT count(*) FROM nation) THEN 'error_extraccion'
            WHEN delta > 3 THEN 'revision_manual' WHEN semana % 23 = 22 AND delta = 0 THEN 'revision_manual'
            WHEN semana % 17 = 16 AND semana % 23 <> 22 THEN 'revision_manual' WHEN delta > 0 THEN 'ok_discrepancia_minima' ELSE 'ok' END AS estado,
        CASE WHEN semana % 23 = 22 THEN NULL WHEN semana % 17 = 16 THEN semana - 1 ELSE semana END AS corte,
        CASE WHEN semana % 23 = 22 THEN NULL WHEN semana % 3 = 0 THEN 'titulo_tabla' WHEN semana % 3 = 1 THEN 'pie_estratificacion' ELSE 'titulo_seccion' END AS fuente
    FROM (SELECT archivo, anio, semana, version, hay_tabla, count(*) AS n_filas, sum(p)::DOUBLE AS suma,
            CASE WHEN semana % 7 = 3 THEN 1 WHEN semana % 9 = 5 THEN 50 ELSE 0 END AS delta FROM not_filas GROUP BY ALL)""",
)
_WEEK = "CASE WHEN semana % 21 <> 8 THEN semana END"


@check(
    "S7_bulletin_corpus",
    """SELECT archivo, anio, lpad(CAST(semana AS VARCHAR), 2, '0') AS semana_archivo, version,
        CASE WHEN hay_tabla THEN 3 ELSE 2 END::BIGINT AS paginas, 'Boletin epidemiologico' AS inicio FROM lab_docs""",
)
def s7(spark, d):
    pages = lab_pages(spark, d)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pagina", "texto"))), lambda x: x["texto"])
    texts = pages.groupBy("anio", "archivo").agg(F.array_join(ordered, bulletin_files.PAGE_BREAK).alias("value"))
    path = new_path(spark, "boletines")
    texts.repartition("anio", "archivo").write.partitionBy("anio", "archivo").text(path, lineSep="\n")
    read = bulletin_files.pages(spark, path)
    return read.groupBy("archivo", "anio", "semana_archivo", "version").agg(
        F.count(F.lit(1)).alias("paginas"), F.min_by(F.split_part("texto", F.lit("\n"), F.lit(1)), "pagina").alias("inicio")
    )


@check("T1_table_page", "SELECT archivo, CAST(2 AS INTEGER) AS pagina FROM lab_docs WHERE hay_tabla")
def t1(spark, d):
    return L.table_pages(lab_pages(spark, d)).select("archivo", "pagina")


@check(
    "T1_notified_table_page",
    "SELECT archivo, CAST(2 AS INTEGER) AS pagina FROM not_docs WHERE hay_tabla AND NOT (semana % 20 = 3 AND semana % 3 <> 1 AND (semana % 3 <> 0 OR semana % 23 = 22))",
)
def t1_notified(spark, d):
    return N.table_pages(notified_pages(spark, d), names(spark, d)).select("archivo", "pagina")


@check(
    "T2_table_block",
    "SELECT archivo, n_filas + 2 AS lineas_tras_titulo FROM lab_docs WHERE hay_tabla",
)
def t2(spark, d):
    """Lines between the header and the end mark: regions, other countries and total."""
    lines = F.size(F.filter(F.split("bloque", "\n"), lambda x: F.trim(x) != ""))
    header = F.when(F.split_part("bloque", F.lit("\n"), F.lit(1)) == "", 1).otherwise(2)
    return L.table_pages(lab_pages(spark, d)).select("archivo", (lines - header).cast("bigint").alias("lineas_tras_titulo"))


@check("T3_schema_family", "SELECT archivo, CASE WHEN con_tasa THEN 'A' ELSE 'B' END AS familia FROM lab_docs WHERE hay_tabla")
def t3(spark, d):
    return L.table_pages(lab_pages(spark, d)).select("archivo", "familia")


@check(
    "T4_cut_weeks",
    f"SELECT archivo, {_WEEK} AS semana_probable, {_WEEK} AS semana_confirmado FROM lab_docs WHERE hay_tabla",
)
def t4(spark, d):
    return L.table_pages(lab_pages(spark, d)).select("archivo", "semana_probable", "semana_confirmado")


@check(
    "T5_region_rows",
    "SELECT archivo, region, p::DOUBLE AS probable, c::DOUBLE AS confirmado FROM lab_filas WHERE hay_tabla",
)
def t5(spark, d):
    tables = L.table_pages(lab_pages(spark, d))
    return L.rows(tables, names(spark, d)).select("archivo", "region", "probable", "confirmado")


@check(
    "T6_width_repair",
    """SELECT archivo, region, CASE WHEN p = 0 AND (region + semana) % 5 = 0 AND (region + semana) % 9 <> 0 THEN -1 ELSE 0 END
        + CASE WHEN (region + semana) % 9 = 0 THEN 1 ELSE 0 END AS columnas_de_mas, p::DOUBLE AS probable FROM lab_filas WHERE hay_tabla""",
)
def t6(spark, d):
    found = L.rows(L.table_pages(lab_pages(spark, d)), names(spark, d))
    width = F.when(F.col("familia") == "A", 3).otherwise(2)
    return found.select("archivo", "region", (F.col("n_crudos") - width).alias("columnas_de_mas"), "probable")


@check(
    "T7_printed_totals",
    "SELECT archivo, 2::DOUBLE AS otros_probable, 1::DOUBLE AS otros_confirmado, tp::DOUBLE AS total_probable, tc::DOUBLE AS total_confirmado FROM lab_docs WHERE hay_tabla",
)
def t7(spark, d):
    return L.with_totals(L.table_pages(lab_pages(spark, d))).select(
        "archivo", "otros_probable", "otros_confirmado", "total_probable", "total_confirmado"
    )


@check(
    "T8_state_without_table",
    """SELECT archivo, CASE WHEN semana % 13 = 0 THEN 'ausencia_esperada_vacacion' WHEN semana % 16 = 15 THEN 'sin_texto_extraible'
        ELSE 'sin_tabla_no_vacacional' END AS estado FROM lab_docs""",
)
def t8(spark, d):
    return L.state_without_table(lab_pages(spark, d)).select("archivo", F.col("_estado_sin").alias("estado"))


@check("T9_document_state", "SELECT archivo, anio, version, estado FROM lab_docs")
def t9(spark, d):
    return lab(spark, d)[0].select("archivo", "anio", "version", "estado")


@check(
    "A20_total_reconciliation",
    """SELECT archivo, sp AS suma_probable, sc AS suma_confirmado, tp = sp AND tc = sc AS validacion_tabla, tp = sp + 2 AND tc = sc + 1 AS validacion_nacional,
        CASE WHEN (tp = sp AND tc = sc) OR (tp = sp + 2 AND tc = sc + 1) THEN TRUE ELSE FALSE END AS cuadra FROM lab_docs WHERE hay_tabla""",
)
def a20(spark, d):
    documents = lab(spark, d)[0].filter(F.col("pagina").isNotNull())
    return documents.select(
        "archivo", "suma_probable", "suma_confirmado", "validacion_tabla", "validacion_nacional",
        B.balance(F.col("validacion_tabla"), F.col("validacion_nacional")).alias("cuadra"),
    )


@check("A10_state_counts", "SELECT anio, estado, count(*) AS boletines FROM lab_docs GROUP BY ALL")
def a10(spark, d):
    return B.state_counts(lab(spark, d)[0])


@check(
    "K7_state_counts",
    """SELECT anio, '{' || string_agg('"' || estado || '":' || n, ',' ORDER BY estado) || '}' AS estados
    FROM (SELECT anio, estado, count(*) AS n FROM lab_docs GROUP BY ALL) GROUP BY anio""",
)
def k7_states(spark, d):
    return cumulative.nested_states(lab(spark, d)[0])


def reviews(documents):
    """Manual decisions on the bulletins of one year that did not balance."""
    chosen = documents.filter((F.col("anio") == 1999) & (F.col("estado") == "revision_manual"))
    return chosen.select("archivo", F.lit("ok").alias("estado"), F.lit("aceptado tras revision").alias("nota"))


@check(
    "T10_manual_reviews",
    """SELECT archivo, CASE WHEN anio = 1999 AND estado = 'revision_manual' THEN 'ok' ELSE estado END AS estado,
        anio = 1999 AND estado = 'revision_manual' AS revisado FROM lab_docs""",
)
def t10(spark, d):
    documents = lab(spark, d)[0]
    return B.apply_reviews(documents, reviews(documents)).select(
        "archivo", "estado", F.col("nota").endswith(" | aceptado tras revision").alias("revisado")
    )


@check(
    "T11_stored_states",
    """SELECT archivo, CASE WHEN estado LIKE 'ausencia_esperada%' THEN 'ausencia_esperada' WHEN estado = 'sin_tabla_no_vacacional' THEN 'revision_manual'
        WHEN estado = 'error_extraccion' THEN 'error' ELSE estado END AS estado, semana AS semana_archivo FROM lab_docs""",
)
def t11(spark, d):
    return lab(spark, d)[0].select(
        "archivo", B.stored_state(F.col("estado")).alias("estado"), B.stored_week(F.col("semana_archivo")).alias("semana_archivo")
    )


@check(
    "T12_known_cases",
    """SELECT archivo, TRUE AS encontrado, CASE WHEN estado = 'ok' THEN semana % 4 <> 3 END AS coincide FROM lab_docs WHERE version = 1""",
)
def t12(spark, d):
    shown = ~((F.col("semana") % 11 == 10) & (F.col("region") == 3))
    counters = A.cuts(spark, d).filter((F.col("version") == 1) & (F.col("clase") == "probable") & shown)
    wrong = F.when(F.col("semana") % 4 == 3, 9).otherwise(0)
    known = counters.groupBy("archivo", "semana").agg(F.sum("acum").alias("s")).select(
        "archivo", (F.col("s") + wrong).alias("suma_probable"), F.lit(None).cast("double").alias("suma_confirmado")
    )
    return B.verify_known(lab(spark, d)[0], known, ["suma_probable", "suma_confirmado"])


view(
    "lab_cortes",
    """SELECT clase, region, anio, semana, arg_max(acum, archivo) AS acum FROM (
        SELECT 'probable' AS clase, f.*, p AS acum FROM lab_filas f JOIN lab_docs USING (archivo) WHERE estado = 'ok'
        UNION ALL SELECT 'confirmado', f.*, c FROM lab_filas f JOIN lab_docs USING (archivo) WHERE estado = 'ok') GROUP BY ALL""",
)


@check(
    "T13_text_to_points",
    """SELECT clase, region, anio, CAST(unnest(CASE WHEN previa IS NOT NULL AND semana - previa > 1 THEN generate_series(previa + 1, semana) ELSE [semana] END) AS INTEGER) AS semana,
        CAST(CASE WHEN previa IS NULL THEN acum WHEN semana - previa = 1 AND acum >= antes THEN acum - antes END AS DOUBLE) AS valor
    FROM (SELECT *, lag(semana) OVER w AS previa, lag(acum) OVER w AS antes FROM lab_cortes WINDOW w AS (PARTITION BY clase, region, anio ORDER BY semana))""",
)
def t13_text(spark, d):
    documents, found = lab(spark, d)
    counters = cumulative.last_cut_wins(L.cuts(documents, found), ["clase", "region"])
    points = cumulative.deaccumulate(counters, ["clase", "region"], mark_first=False)
    return points.select("clase", "region", "anio", "semana", "valor")


# --- single-series bulletins ----------------------------------------------


def notified_pages(spark, d):
    return stored(bulletin_texts.notified_pages(spark, d))


def notified(spark, d):
    return N.analyse(notified_pages(spark, d), names(spark, d))


_TABLE = "hay_tabla AND semana % 20 <> 3"


@check("T9_notified_document_state", "SELECT archivo, anio, version, estado FROM not_docs")
def t9_notified(spark, d):
    return notified(spark, d)[0].select("archivo", "anio", "version", "estado")


view(
    "not_cortes",
    """SELECT f.region, d.anio, CAST(d.corte AS INTEGER) AS semana, arg_max(CAST(f.p AS DOUBLE), archivo) AS acum
    FROM not_filas f JOIN not_docs d USING (archivo)
    WHERE d.estado IN ('ok', 'ok_discrepancia_minima') AND d.corte IS NOT NULL GROUP BY ALL""",
)


@check(
    "T13_notified_text_to_points",
    """SELECT region, anio, CAST(unnest(CASE WHEN previa IS NOT NULL AND semana - previa > 1 THEN generate_series(previa + 1, semana) ELSE [semana] END) AS INTEGER) AS semana,
        CASE WHEN previa IS NULL THEN acum WHEN semana - previa = 1 AND acum >= antes THEN acum - antes END AS valor
    FROM (SELECT *, lag(semana) OVER w AS previa, lag(acum) OVER w AS antes FROM not_cortes WINDOW w AS (PARTITION BY region, anio ORDER BY semana))""",
)
def t13_notified(spark, d):
    documents, found = notified(spark, d)
    counters = cumulative.last_cut_wins(N.cuts(documents, found), ["region"])
    points = cumulative.deaccumulate(counters, ["region"])
    return points.select("region", "anio", "semana", F.col("valor").cast("double").alias("valor"))


@check(
    "T10_notified_reviews",
    """SELECT archivo, CASE WHEN anio = 1999 AND estado = 'revision_manual' THEN 'ok' ELSE estado END AS estado,
        anio = 1999 AND estado = 'revision_manual' AS revisado FROM not_docs""",
)
def t10_notified(spark, d):
    documents = notified(spark, d)[0]
    return B.apply_reviews(documents, reviews(documents)).select(
        "archivo", "estado", F.col("nota").endswith("aceptado tras revision").alias("revisado")
    )


@check(
    "T4_notified_cut_week",
    f"""SELECT archivo, corte AS semana_corte, fuente AS fuente_semana,
        CASE WHEN fuente = 'titulo_tabla' AND semana % 4 = 1 THEN 'lado_a_lado' ELSE 'pagina_propia' END AS disposicion FROM not_docs WHERE {_TABLE}""",
)
def t4_notified(spark, d):
    documents = notified(spark, d)[0].filter("n_filas > 0")
    return documents.select("archivo", "semana_corte", "fuente_semana", "disposicion")


@check(
    "T5_notified_region_rows",
    f"SELECT archivo, region, p::DOUBLE AS total, 12.5::DOUBLE AS tasa FROM not_filas WHERE {_TABLE}",
)
def t5_notified(spark, d):
    return notified(spark, d)[1]


@check(
    "A21_nearest_total",
    f"""SELECT archivo, suma, CASE WHEN semana % 5 = 2 THEN 4::DOUBLE END AS otros, suma + delta + CASE WHEN semana % 5 = 2 THEN 4 ELSE 0 END AS total_impreso,
        0.0::DOUBLE - delta AS diferencia FROM not_docs WHERE {_TABLE}""",
)
def a21(spark, d):
    documents = notified(spark, d)[0].filter("n_filas > 0")
    return documents.select("archivo", "suma", "otros", "total_impreso", "diferencia")


view("not_vigentes", "SELECT * FROM not_docs QUALIFY row_number() OVER (PARTITION BY anio, semana ORDER BY version DESC, archivo DESC) = 1")
view(
    "not_orden",
    """SELECT archivo, lag(archivo) OVER (PARTITION BY anio ORDER BY corte, archivo) AS previo FROM not_vigentes
    WHERE estado IN ('ok', 'ok_discrepancia_minima') AND corte IS NOT NULL""",
)
view("not_tablas", "SELECT archivo, list({'r': region, 'p': p} ORDER BY region) AS filas FROM not_filas GROUP BY archivo")
view(
    "not_repetidas",
    """SELECT o.archivo, o.previo FROM not_orden o JOIN not_tablas a ON a.archivo = o.archivo JOIN not_tablas b ON b.archivo = o.previo
    WHERE a.filas = b.filas""",
)
view(
    "not_finales",
    """SELECT v.* REPLACE (CASE WHEN previo IS NOT NULL THEN 'revision_manual' ELSE estado END AS estado), previo
    FROM not_vigentes v LEFT JOIN not_repetidas r ON r.archivo = v.archivo""",
)
view(
    "not_puntos",
    """SELECT *, CASE WHEN previa IS NULL AND semana > 1 THEN 'primer_corte' WHEN previa IS NULL THEN 'valor' WHEN semana - previa > 1 THEN 'hueco'
            WHEN acum < antes THEN 'correccion' ELSE 'valor' END AS tipo
    FROM (SELECT *, lag(semana) OVER w AS previa, lag(acum) OVER w AS antes FROM (
            SELECT f.region, d.anio, CAST(d.corte AS INTEGER) AS semana, arg_max(CAST(f.p AS DOUBLE), archivo) AS acum
            FROM not_filas f JOIN not_finales d USING (archivo)
            WHERE d.estado IN ('ok', 'ok_discrepancia_minima') AND d.corte IS NOT NULL GROUP BY ALL)
          WINDOW w AS (PARTITION BY region, anio ORDER BY semana))""",
)


def notified_event_of(spark, d):
    return notified_event.documents_and_rows(notified_pages(spark, d), names(spark, d))


@check("T9_notified_reprints", "SELECT archivo, estado, previo IS NOT NULL AS repetida FROM not_finales")
def t9_reprints(spark, d):
    documents, _ = notified_event_of(spark, d)
    return documents.select("archivo", "estado", F.col("nota").startswith("la tabla repite").alias("repetida"))


@check(
    "T13_notified_fact_rows",
    """SELECT region, 'ira' AS evento, anio, semana, 'notificado' AS clasificacion, 'boletin' AS fuente,
        CAST(CASE WHEN previa IS NULL THEN acum ELSE acum - antes END AS INTEGER) AS conteo FROM not_puntos WHERE tipo = 'valor'
    UNION ALL SELECT 0, 'ira', 1990, 1, 'notificado', 'boletin', 7""",
)
def t13_facts(spark, d):
    """Loaded twice over a fact with stale counts of even weeks and one row of its own."""
    rows = stored(notified_event.fact_rows(notified_event.weekly_points(*notified_event_of(spark, d)), A.regions(spark, d), "ira", "boletin"))
    own = spark.range(1).select(
        F.lit(0).alias("region"), F.lit("ira").alias("evento"), F.lit(1990).alias("anio"), F.lit(1).alias("semana"),
        F.lit("notificado").alias("clasificacion"), F.lit("boletin").alias("fuente"), F.lit(7).alias("conteo"))
    stale = rows.filter("semana % 2 = 0").withColumn("conteo", F.lit(-1))
    return notified_event.load(notified_event.load(stale.unionByName(own), rows), rows)


@check(
    "T13_notified_load_report",
    """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS leidas, CAST(coalesce(sum(n) FILTER (tipo = 'valor'), 0) AS BIGINT) AS insertadas,
        CAST(coalesce(sum(n) FILTER (tipo = 'primer_corte'), 0) AS BIGINT) AS primeros_cortes, CAST(coalesce(sum(n) FILTER (tipo = 'hueco'), 0) AS BIGINT) AS huecos,
        CAST(coalesce(sum(n) FILTER (tipo = 'correccion'), 0) AS BIGINT) AS correcciones
    FROM (SELECT tipo, CASE WHEN tipo = 'hueco' THEN semana - previa ELSE 1 END AS n FROM not_puntos)""",
)
def t13_report(spark, d):
    return notified_event.load_report(notified_event.weekly_points(*notified_event_of(spark, d)))
