"""Aborts carried by the rows, counters of the same job, date ranges at the scan, rules as data."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from weekwatch.functions import calendar as cal
from weekwatch.operators import anomaly, calendar, contracts, features, folds, integrity, metrics, ranking, summary, weekly
from weekwatch.plans import adapters as A
from weekwatch.plans import endpoints as E
from weekwatch.plans import lead_time, notified_event

DATA = "/root/testdata/sf0.001"


def aborts(frame, message):
    with pytest.raises(Exception, match=message):
        frame.write.format("noop").mode("overwrite").save()


def test_require_names_the_offending_row(spark):
    rows = spark.range(5).withColumn("x", F.col("id") % 4)
    assert contracts.require(rows, F.col("x") < 4, "too large").count() == 5
    aborts(contracts.require(rows, F.col("x") < 3, contracts.named("too large", ["id", "x"])), "too large: id=3, x=3")
    aborts(contracts.require(rows.withColumn("x", F.lit(None).cast("int")), F.col("x") < 3, "unknown"), "unknown")
    aborts(contracts.matched(rows, spark.range(4), ["id"]), "no partner: id=4")
    aborts(contracts.unique(rows, ["x"]), "repeated key: x=0")
    assert contracts.unique(rows, ["id"]).columns == ["id", "x"]
    aborts(contracts.without(rows.filter("false"), rows.filter("x = 3"), "offence"), "offence")
    assert contracts.without(rows, rows.filter("x = 9"), "offence").count() == 5


def test_a_region_that_reports_twice_aborts_the_strict_mean(spark):
    rows = [("a", 2020, 1, "t", Decimal("1")), ("b", 2020, 1, "t", Decimal("2")), ("a", 2020, 1, "t", Decimal("5"))]
    df = spark.createDataFrame(rows, "region string, anio int, semana int, variable string, valor decimal(10,3)")
    for part in weekly.strict_national_mean(df, 2):
        aborts(part, "repeated weekly values: anio=2020, semana=1, variable=t")
    assert weekly.strict_national_mean(df.limit(2), 2)[0].count() == 1


def test_an_index_without_variation_aborts(spark):
    good = spark.range(50).select((F.col("id") / 50).alias("iv"))
    assert anomaly.require_variation(good, "iv").count() == 50
    aborts(anomaly.require_variation(good.select(F.lit(0.4).alias("iv")), "iv"), "constant")
    saturated = good.select(F.when(F.col("iv") > 0, 1.0).otherwise(0.5).alias("iv"))
    aborts(anomaly.require_variation(saturated, "iv"), "saturated")
    flat = spark.range(8).select(F.lit(1).alias("region"), F.lit(2000).alias("anio"), F.col("id").cast("int").alias("semana"), F.lit(0.2).alias("iv"))
    cases = flat.select("anio", "semana", F.lit(1.0).alias("valor"))
    aborts(lead_time.national(flat, 1, cases, [2000], [2000]).join(flat, "anio"), "constant")


def test_counters_come_from_the_job_that_writes(spark):
    weeks = calendar.generate(spark.createDataFrame([(2000, 2001)], "anio_min int, anio_max int"))
    days = spark.createDataFrame([(date(2000, 1, 2),), (date(2001, 1, 7),), (date(2000, 1, 3),), (date(1999, 1, 3),)], "fecha_inicio date")
    seen = Observation("a")
    assert calendar.weeks_in_years(days, weeks, 2000, 2000, seen).count() == 1
    assert seen.get == {"leidas": 4, "sin_semana": 2, "fuera_de_rango": 1, "cargadas": 1}
    months = spark.createDataFrame([(2000, m, 1.0) for m in range(1, 13)], "anio int, mes int, anom double")
    seen = Observation("b")
    calendar.monthly_to_weekly(months, weeks, seen=seen).collect()
    assert seen.get["semanas"] == weeks.count() and 50 < seen.get["sin_dato"] < 54
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, "y")], "id int, motivo string")
    seen = Observation("c")
    assert features.usable_rows(rows, ["x", "y"], seen).columns == ["id"]
    features.usable_rows(rows, ["x", "y"], seen := Observation("d")).collect()
    assert seen.get == {"candidatas": 4, "filas_finales": 1, "x": 2, "y": 1}


def test_week_ranges_cover_exactly_their_weeks(spark):
    days = [date(1999, 12, 20) + timedelta(days=i) for i in range(1200)]
    start = cal.week_start(F.col("d"))
    known = {r.d: (r.y, r.w) for r in spark.createDataFrame([(d,) for d in days], "d date").select("d", cal.mmwr_year(start).alias("y"), cal.mmwr_week(start).alias("w")).collect()}
    for years, weeks in (((2000, 2002), None), ((2000, 2001), (1, 2, 3)), ((2000,), (52, 53)), ((2001, 2002), (52, 53, 1)), ((2001,), (0, 54))):
        ranges = cal.week_ranges(years, weeks)
        inside = {d for d in days if any(a <= d < b for a, b in ranges)}
        assert inside == {d for d, (y, w) in known.items() if y in years and (weeks is None or w in weeks)}
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dates_reach_the_scan_and_the_fact_is_read_once(spark):
    fact = A.facts(spark, DATA, E.pressure_days(A.BASE_YEARS, 2000, 20))
    text = plan(E.pressure_of_week(fact, A.regions(spark, DATA), A.BASE_YEARS, 20, 2000))
    pushed = [line for line in text.split("\n") if "o_orderdate" in line and "PushedFilters" in line]
    assert len(pushed) == 1 and "GreaterThanOrEqual(o_orderdate" in pushed[0] and "LessThan(o_orderdate" in pushed[0]
    days = A.daily_payload(spark, DATA, E.suitability_days((1996, 1997), 20))
    text = plan(weekly.weekly_wide(days, ["region"], A.VARIABLES, A.ACCUMULATIVE))
    assert "GreaterThanOrEqual(l_shipdate" in text and "Expand" not in text


def test_no_unpivot_below_the_weekly_aggregate(spark):
    text = plan(weekly.weekly_long(A.daily_payload(spark, DATA), ["region"], A.VARIABLES, A.ACCUMULATIVE))
    assert text.count("Expand") + text.count("Generate") == 1 and min(
        x for x in (text.find("Expand"), text.find("Generate")) if x >= 0) < text.index("HashAggregate")


def test_ranges_follow_the_size_of_their_group(spark):
    big = spark.range(4000).select(F.lit("g").alias("k"), (F.col("id") * 7 % 4000).alias("v"), F.lit(1).alias("n"))
    small = spark.range(3).select(F.lit("p").alias("k"), F.col("id").alias("v"), F.lit(1).alias("n"))
    rows = ranking.running_totals(big.unionByName(small), "v", ["n"], ["k"], range_values=300)
    assert rows.filter("n_antes <> v").count() == 0 and rows.filter("k = 'p' AND n_grupo <> 3").count() == 0
    text = plan(rows)
    assert "_tramo" in text
    at = ranking.values_at(big, "v", {"a": F.lit(0), "m": F.floor(F.col("n") / 2), "z": F.col("n") - 1}).first()
    assert (at.a, at.m, at.z) == (0, 2000, 3999)
    assert ranking.values_at(big.filter("false"), "v", {"a": F.lit(0)}).first().a is None


def test_map_breaks_and_volume_rank_against_sorting(spark):
    values = [5, 1, None, 9, 9, 2, 7, 7, 7, 3]
    rows = spark.createDataFrame(list(enumerate(values)), "region int, total int")
    known = sorted(v for v in values if v is not None)
    cuts = [known[int(s * (len(known) - 1))] for s in (0.2, 0.4, 0.6, 0.8)]
    for r in summary.map_breaks(rows, "total").collect():
        assert r.tramo == (None if r.total is None else next((i for i, c in enumerate(cuts) if r.total <= c), 4))
    volumes = rows.dropna().select("region", F.col("total").alias("volumen_total"))
    got = {r.region: r.puesto for r in summary.rank_by_volume(volumes, "region").collect()}
    order = sorted((-v, i) for i, v in enumerate(values) if v is not None)
    assert got == {i: k for k, (_, i) in enumerate(order, 1)}
    assert "SinglePartition" not in plan(summary.rank_by_volume(volumes, "region")).split("Window")[1]


def test_threshold_buckets_against_one_copy_per_threshold(spark):
    rows = [(c, p, s / 10) for s in range(11) for c in ("bajo", "medio", "alto") for p in ("bajo", "alto", None)]
    preds = spark.createDataFrame(rows, "real string, pred string, p double").withColumn("g", F.lit(1))
    got = {r.umbral: r for r in metrics.threshold_sweep(preds, ["g"], "p", (0.5, 0.2, 0.95)).collect()}
    for t, r in got.items():
        one = metrics.class_metrics(preds.withColumn("pred", F.when(F.col("p") > t, "alto").otherwise(F.col("pred"))), ["g"]).first()
        assert (r.recall_alto, r.precision_alto, r.soporte_alto, r.f1_macro) == (one.recall_alto, one.precision_alto, one.soporte_alto, one.f1_macro)
    assert set(got) == {0.2, 0.5, 0.95}


def test_signature_gate_names_fold_and_field(spark):
    columns = ["pais", "anio_externo", *folds.SIGNATURE_FIELDS]
    own = spark.createDataFrame([("a", 2000, "entrenable", "", *range(8)), ("b", 2000, "sin_test", "", *range(8))], columns)
    assert folds.require_signature(own, own, "pais").count() == 2
    frozen = own.withColumn("prueba_alto", F.when(F.col("pais") == "b", 99).otherwise(F.col("prueba_alto")))
    aborts(folds.require_signature(own, frozen, "pais"), "pais=b, anio_externo=2000, campo=prueba_alto, esperado=99, observado=7")
    aborts(folds.require_signature(own, own.filter("pais = 'a'"), "pais"), "pais=b, .*campo=fold, esperado=ausente")


def test_rules_find_each_kind_of_offence(spark):
    weeks = integrity.with_successor(spark.createDataFrame(
        [(2000, 1, date(2000, 1, 2), date(2000, 1, 8)), (2000, 2, date(2000, 1, 9), date(2000, 1, 14)), (2000, 54, date(2000, 1, 23), date(2000, 1, 29))],
        "anio int, semana int, fecha_inicio date, fecha_fin date"))
    log = spark.createDataFrame([("f1", 2000, "ok", "A"), ("f1", 2000, "ok", None), ("f2", None, "raro", "C")], "archivo string, anio int, estado string, familia string")
    got = sorted(map(tuple, integrity.violations({"calendario": weeks, "bitacora": log}).collect()))
    assert got == sorted([
        ("bitacora_clave_unica", "f1", 2), ("bitacora_estado", "f2", 1), ("bitacora_familia", "f2", 1), ("bitacora_obligatorios", "f2||raro", 1),
        ("calendario_continuo", "2000-01-16", 1), ("calendario_semana", "2000|54", 1), ("calendario_siete_dias", "2000|2", 1)])
    with pytest.raises(ValueError):
        integrity.violations({"otra": weeks})


def test_repeated_tables_go_to_review_and_load_is_idempotent(spark):
    documents = [("a1", 2000, "01", 1, "ok", 1), ("a2", 2000, "02", 1, "ok", 2), ("a3", 2000, "03", 1, "ok", 3), ("a3b", 2000, "03", 2, "ok_discrepancia_minima", 3),
                 ("a4", 2000, "04", 1, "ok", 4), ("b1", 2001, "01", 1, "ok", 4), ("x", 2000, "05", 1, "revision_manual", 5)]
    docs = spark.createDataFrame([(*d, "") for d in documents], "archivo string, anio int, semana_archivo string, version int, estado string, semana_corte int, nota string")
    tables = {"a1": (5, 7), "a2": (9, 8), "a3": (1, 1), "a3b": (9, 8), "a4": (9, 8), "b1": (9, 8), "x": (9, 8)}
    found = spark.createDataFrame([(a, r, float(v)) for a, t in tables.items() for r, v in enumerate(t)], "archivo string, region int, total double")
    from weekwatch.operators import bulletins_notified as N

    final = N.review_reprints(N.current(docs), found)
    states = {r.archivo: (r.estado, r.nota) for r in final.collect()}
    assert set(states) == {"a1", "a2", "a3b", "a4", "b1", "x"}
    assert states["a2"] == ("ok", "") and states["b1"][0] == "ok"
    assert states["a3b"] == ("revision_manual", "la tabla repite la del corte SE2 (a2)")
    assert states["a4"] == ("revision_manual", "la tabla repite la del corte SE3 (a3b)")
    points = notified_event.weekly_points(final, found)
    catalogue = spark.createDataFrame([(0,), (1,)], "region int")
    rows = notified_event.fact_rows(points, catalogue, "ira", "boletin")
    assert sorted((r.region, r.anio, r.semana, r.conteo) for r in rows.collect()) == [(0, 2000, 1, 5), (0, 2000, 2, 4), (1, 2000, 1, 7), (1, 2000, 2, 1)]
    once = notified_event.load(rows.limit(0), rows)
    assert sorted(map(tuple, notified_event.load(once, rows).collect())) == sorted(map(tuple, rows.collect()))
    assert notified_event.load_report(points).first().asDict() == {"leidas": 6, "insertadas": 4, "primeros_cortes": 2, "huecos": 0, "correcciones": 0}
    aborts(notified_event.fact_rows(points, catalogue.filter("region = 0"), "ira", "boletin"), "region without catalogue entry: region=1")


def test_a_correction_of_a_fractional_counter_gets_its_note(spark):
    from weekwatch.operators import cumulative

    cuts = spark.createDataFrame([(1, 2000, 1, 10.0), (1, 2000, 2, 7.5)], "region int, anio int, semana int, acum double")
    notes = {r.semana: r.nota for r in cumulative.deaccumulate(cuts, ["region"]).collect()}
    assert notes[2] == "correccion retroactiva: diff=-2 (excluida de la serie)"
