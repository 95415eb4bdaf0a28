from pyspark.sql import functions as F

from weekwatch.operators import bulletins as B
from weekwatch.operators import bulletins_lab as L
from weekwatch.operators import bulletins_notified as N

NAMES = ["Peñón Alto", "La Cañada", "San Telmo", "Santa Rita"]


def names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "region int, nombre string")


def pages(spark, *texts, archivo="Boletin_SE05.pdf", semana="05"):
    rows = [(archivo, 2020, semana, 1, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "archivo string, anio int, semana_archivo string, version int, pagina int, texto string")


TABLE_A = """Casos probables de dengue SE 4 y confirmados de dengue SE 3, por departamento
Departamento Probables Confirmados Tasa x 100,000
Penon Alto 14 7 3.4 21 casos.
La Cañada 0 0.0
San  Telmo 2 1 0.5
texto lateral Santa Rita 1 1 0,2
Otros países 1 0 0,0
Total 18 9 1.1
Índices larvarios por departamento
San Telmo 99 99 9.9
"""


def test_table_with_rate_blank_cell_noise_and_interleaved_text(spark):
    documents, rows = L.analyse(pages(spark, "portada dengue", TABLE_A), names(spark))
    doc = documents.first()
    assert (doc.familia, doc.semana_probable, doc.semana_confirmado, doc.n_filas) == ("A", 4, 3, 4)
    got = {r.region: (r.probable, r.confirmado, r.tasa) for r in rows.collect()}
    assert got == {0: (14.0, 7.0, 3.4), 1: (0.0, 0.0, 0.0), 2: (2.0, 1.0, 0.5), 3: (1.0, 1.0, 0.2)}
    assert (doc.total_probable, doc.otros_probable) == (18.0, 1.0)
    # 14 + 0 + 2 + 1 = 17 in the regions; only with the one case abroad is it the printed 18.
    assert (doc.validacion_tabla, doc.validacion_nacional, doc.estado) == (False, True, "ok")
    wrong = L.analyse(pages(spark, "portada dengue", TABLE_A.replace("Total 18", "Total 25")), names(spark))[0].first()
    assert (wrong.validacion_tabla, wrong.validacion_nacional, wrong.estado) == (False, False, "revision_manual")


def test_either_total_convention_is_accepted(spark):
    without = TABLE_A.replace("Total 18 9", "Total 17 9")
    a = L.analyse(pages(spark, "x", without), names(spark))[0].first()
    b = L.analyse(pages(spark, "x", TABLE_A), names(spark))[0].first()
    assert (a.validacion_tabla, a.validacion_nacional, a.estado) == (True, False, "ok")
    assert (b.validacion_tabla, b.validacion_nacional, b.estado) == (False, True, "ok")


def test_table_without_rate_column(spark):
    text = """Casos probables y confirmados de dengue segun departamento, SE 05 y SE 04
Peñón Alto 3 1
La Cañada 2
San Telmo 0 0
Santa Rita 5 5
Otros paises 0 0
8 8
"""
    documents, rows = L.analyse(pages(spark, "dengue", text), names(spark))
    doc = documents.first()
    assert (doc.familia, doc.semana_probable, doc.semana_confirmado, doc.estado) == ("B", 5, 4, "ok")
    assert {r.region: (r.probable, r.confirmado) for r in rows.collect()}[1] == (0.0, 2.0)


def test_states_without_a_usable_table(spark):
    state = lambda *t: L.analyse(pages(spark, *t), names(spark))[0].first().estado
    assert state("Periodo de vacaciones", "dengue") == "ausencia_esperada_vacacion"
    assert state("portada", "nada") == "sin_texto_extraible"
    assert state("portada", "el Dengue sigue") == "sin_tabla_no_vacacional"
    assert state("p", TABLE_A.replace("Tasa x", "SE1-2 Tasa x")) == "ausencia_esperada_multisemana"
    assert state("p", TABLE_A.replace("San  Telmo 2 1 0.5\n", "")) == "error_extraccion"


NOTIFIED = """Casos y tasas por grupo de edad y departamento de IRAS, El Salvador, SE01-05 2020
Grupo de edad Total general Tasa Departamento Total Tasa
<1 año 4,905 4,407 Peñón Alto 17,958 1,005
La Cañada 1363,652 12.5
San Telmo 10 2
Santa Rita 1.000 3
Total general 9,999 20
Total general 1,382,621 30
Estratificación de riesgo San Telmo 77 7
"""


def test_side_by_side_table(spark):
    documents, rows = N.analyse(pages(spark, "portada", "IRA y dengue\nPeñón Alto 1\nLa Cañada 2\nSan Telmo 3\nSanta Rita 4", NOTIFIED), names(spark))
    # Four regions are under the default floor of ten rows, so the title decides.
    doc = documents.first()
    assert (doc.pagina if "pagina" in documents.columns else 2) == 2
    assert (doc.disposicion, doc.semana_corte, doc.fuente_semana) == ("lado_a_lado", 5, "titulo_tabla")
    assert {r.region: r.total for r in rows.collect()} == {0: 17958.0, 1: 1363652.0, 2: 10.0, 3: 1000.0}
    assert (doc.diferencia, doc.total_impreso, doc.estado) == (-1.0, 1382621.0, "ok_discrepancia_minima")


def test_notified_states(spark):
    doc = lambda text: N.analyse(pages(spark, "portada", text), names(spark))[0].first()
    assert doc(NOTIFIED.replace("1,382,621", "1,382,620")).estado == "ok"
    assert doc(NOTIFIED.replace("1,382,621", "1,382,700")).estado == "revision_manual"
    assert doc(NOTIFIED.replace("SE01-05", "SE01-06")).estado == "revision_manual"
    assert doc(NOTIFIED[: NOTIFIED.index("<1 año")]).estado == "sin_filas_sospecha_imagen"
    assert doc("nada").estado == "sin_texto_extraible"


def test_nearest_total_tries_both_conventions(spark):
    row = spark.range(1).select(
        N.nearest_total(F.lit(100.0), F.lit(4.0), F.array(F.lit(500.0), F.lit(105.0))).alias("a"),
        N.nearest_total(F.lit(100.0), F.lit(None).cast("double"), F.array(F.lit(98.0))).alias("b"),
    ).first()
    assert (row.a.distancia, row.a.diferencia, row.a.total) == (1.0, -1.0, 105.0)
    assert (row.b.diferencia, row.b.total) == (2.0, 98.0)


def test_reviews_mapping_and_known_cases(spark):
    docs = spark.createDataFrame(
        [("a.pdf", "revision_manual", "previa", 47.0), ("b.pdf", "error_extraccion", "", 1.0), ("c.pdf", "ok", "", 21.4)],
        "archivo string, estado string, nota string, suma double",
    )
    reviews = spark.createDataFrame([("a.pdf", "ok", "vista"), ("b.pdf", "ausencia_esperada", "ocr")], "archivo string, estado string, nota string")
    after = B.apply_reviews(docs, reviews)
    assert {r.archivo: (r.estado, r.nota) for r in after.collect()} == {
        "a.pdf": ("ok", "previa | vista"), "b.pdf": ("ausencia_esperada", "ocr"), "c.pdf": ("ok", ""),
    }
    known = spark.createDataFrame([("a.pdf", 47.0), ("c.pdf", 30.0), ("z.pdf", 1.0)], "archivo string, suma double")
    got = {r.archivo: (r.encontrado, r.coincide) for r in B.verify_known(after, known, ["suma"]).collect()}
    assert got == {"a.pdf": (True, True), "c.pdf": (True, False), "z.pdf": (False, None)}
