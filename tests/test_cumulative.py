import json

from pyspark.sql import functions as F

from weekwatch.operators import cumulative, integrity, upsert


def cuts(spark, rows, region="r"):
    return spark.createDataFrame([(region, 2019, w, a, f"SE{w:02d}2019.pdf") for w, a in rows], "region string, anio int, semana int, acum bigint, archivo string")


def points(df, **kw):
    return {r.semana: (r.valor, r.tipo) for r in cumulative.deaccumulate(df, ["region"], **kw).collect()}


def test_consecutive_cuts_are_differences(spark):
    assert points(cuts(spark, [(1, 4), (2, 9), (3, 9)])) == {1: (4.0, "valor"), 2: (5.0, "valor"), 3: (0.0, "valor")}


def test_gap_marks_every_week_and_spreads_nothing(spark):
    got = points(cuts(spark, [(1, 4), (15, 60), (16, 61)]))
    assert got[16] == (1.0, "valor")
    assert {w: v for w, v in got.items() if v[1] == "hueco"} == {w: (None, "hueco") for w in range(2, 16)}


def test_gap_is_tested_before_the_sign(spark):
    assert points(cuts(spark, [(1, 9), (3, 4)])) == {1: (9.0, "valor"), 2: (None, "hueco"), 3: (None, "hueco")}


def test_correction_is_null_and_listed(spark):
    df = cuts(spark, [(1, 9), (2, 8), (3, 10)])
    assert points(df)[2] == (None, "correccion") and points(df)[3] == (2.0, "valor")
    row = cumulative.corrections(df, ["region"]).first()
    assert (row.semana, row.diferencia, row.acumulado_anterior, row.acumulado_actual) == (2, -1, 9, 8)
    note = cumulative.deaccumulate(df, ["region"]).filter("semana = 2").first().nota
    assert note == "correccion retroactiva: diff=-1 (excluida de la serie)"


def test_first_cut_is_kept_whole_and_flagged_on_demand(spark):
    df = cuts(spark, [(3, 30), (4, 31)])
    assert points(df)[3] == (30.0, "primer_corte")
    assert points(df, mark_first=False)[3] == (30.0, "valor")
    counters = cumulative.load_counters(cumulative.deaccumulate(df, ["region"])).first()
    assert (counters.insertadas, counters.huecos_omitidos) == (2, 0)


def test_versions(spark):
    files = spark.createDataFrame(
        [("a.pdf", 2019, "05", 1), ("b_v3.pdf", 2019, "05", 3), ("c_v2.pdf", 2019, "05", 2), ("x.pdf", 2019, None, 1), ("y.pdf", 2019, None, 1)],
        "archivo string, anio int, semana_archivo string, version int",
    )
    got = {r.archivo: (r.vigente, r.nota) for r in cumulative.resolve_versions(files).collect()}
    assert got["a.pdf"] == (False, "version 1 superada por version 3") and got["b_v3.pdf"] == (True, None)
    assert got["x.pdf"][0] and got["y.pdf"][0] and not got["c_v2.pdf"][0]


def test_reprint_needs_all_regions(spark):
    both = cuts(spark, [(1, 5), (2, 5), (3, 6)]).unionByName(cuts(spark, [(1, 7), (2, 7), (3, 7)], "s"))
    assert [(r.semana, r.previa) for r in cumulative.reprints(both).collect()] == [(2, 1)]
    missing = both.filter("NOT (region = 's' AND semana = 2)")
    assert cumulative.reprints(missing).count() == 0


def test_monotonicity_counts(spark):
    row = cumulative.monotonicity(cuts(spark, [(1, 5), (2, 5), (3, 6), (9, 2)]), ["region"]).first()
    assert tuple(row) == (1, 1, 1)


def test_last_file_of_a_week_wins(spark):
    df = spark.createDataFrame([("r", 2019, 1, 5, "a.pdf"), ("r", 2019, 1, 9, "b.pdf")], "region string, anio int, semana int, acum bigint, archivo string")
    row = cumulative.last_cut_wins(df, ["region"]).first()
    assert (row.acum, row.archivo) == (9, "b.pdf")


def test_nested_series_is_json_in_week_order(spark):
    df = cuts(spark, [(2, 10), (3, 9), (1, 4)])
    text = cumulative.nested_series(cumulative.deaccumulate(df, ["region"]), "region").first().series
    parsed = json.loads(text)
    assert parsed["2019"][0] == [1, 4] and parsed["2019"][1] == [2, 6] and parsed["2019"][2][:2] == [3, None]


def test_half_even_rounding_of_cases(spark):
    df = spark.createDataFrame([(0.5, "", "valor"), (1.5, "", "valor"), (2.5, "", "valor"), (None, "x", "hueco")], "valor double, nota string, tipo string")
    assert sorted(r.conteo for r in cumulative.case_rows(df).collect()) == [0, 2, 2]


def test_upsert_is_idempotent_and_new_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    once = upsert.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, upsert.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, upsert.insert_absent(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_one_key_with_most_of_the_copies(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    best = upsert.last_wins(rows, ["k"], ["v"])
    assert best.filter("k = 0").first().v == 199_998 and best.count() == rows.select("k").distinct().count()


def test_constraint_rules(spark):
    cols = "region int, evento string, anio int, semana int, clasificacion string, fuente string, conteo bigint"
    fact = spark.createDataFrame(
        [(1, "d", 2020, 1, "probable", "f", 3), (1, "d", 2020, 1, "probable", "f", 3), (2, "d", 2021, 54, "raro", "g", -1)], cols
    )
    found = integrity.case_fact_violations(
        fact,
        spark.createDataFrame([(2020, 1)], "anio int, semana int"),
        spark.createDataFrame([(1,)], "region int"),
        spark.createDataFrame([("f",)], "fuente string"),
    )
    assert {(r.regla, r.filas) for r in found.collect()} == {
        ("clave_unica", 2), ("fk_calendario", 1), ("fk_region", 1), ("fk_fuente", 1),
        ("dominio_clasificacion", 1), ("conteo_negativo", 1), ("semana_fuera_de_rango", 1),
    }
