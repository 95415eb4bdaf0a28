from decimal import Decimal

from pyspark.sql import functions as F

from weekwatch.operators import pressure
from weekwatch.plans import adapters as A
from weekwatch.plans import endpoints as E
from weekwatch.sources import writers

YEARS = (2018, 2019, 2021, 2022, 2023)


def regions(spark):
    rows = [(1, "SV-A", "Alfa", 1), (2, "SV-B", "Beta", 1), (3, "SV-C", "Gama", 1), (0, "SV", "Pais", 0)]
    return spark.createDataFrame(rows, "region int, codigo string, nombre string, nivel_admin int")


def fact(spark):
    rows = [(1, c, "f", y, w, y - 2017 + w) for c in ("probable", "confirmado", "notificado") for y in YEARS for w in (9, 10, 11)]
    rows += [(2, "probable", "f", y, 10, 1) for y in YEARS[:2]] + [(0, "total", "g", 2018, 10, 999)]
    return spark.createDataFrame(rows, "region int, clasificacion string, fuente string, anio int, semana int, conteo int")


def test_pressure_of_week_keeps_every_region(spark):
    got = {r.codigo: r for r in E.pressure_of_week(fact(spark), regions(spark), YEARS, 10, 2023).collect()}
    assert set(got) == {"SV-A", "SV-B", "SV-C"}
    assert got["SV-A"].probable_casos_observados == 16.0 and got["SV-A"].confirmado_percentil == 100.0
    assert got["SV-A"].probable_n_obs_baseline == 12
    assert got["SV-B"].probable_nota == pressure.NOTE_INSUFFICIENT and got["SV-B"].probable_n_obs_baseline == 2
    assert got["SV-C"].confirmado_n_obs_baseline == 0 and got["SV-C"].confirmado_nota == pressure.NOTE_INSUFFICIENT


def test_pressure_of_region_lists_weeks_seen_in_any_year(spark):
    rows = E.pressure_of_region(fact(spark), regions(spark), YEARS, 2020, "SV-A").orderBy("semana").collect()
    assert [r.semana for r in rows] == [9, 10, 11]
    assert all(r.probable_nota == pressure.NOTE_MISSING and r.probable_n_obs_baseline >= 10 for r in rows)
    assert E.pressure_of_region(fact(spark), regions(spark), YEARS, 2020, "SV-X").count() == 0


def test_requests_prune_the_stored_fact(spark, tmp_path):
    path = str(tmp_path / "hechos")
    writers.facts(fact(spark), path)
    plan = E.pressure_of_week(spark.read.parquet(path), regions(spark), YEARS, 10, 2023)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [anio" in text
    pushed = text[text.index("PushedFilters"):]
    assert "In(semana" in pushed and "In(clasificacion" in pushed
    assert "fuente" not in text[text.index("ReadSchema"):].split("\n")[0]


def weekly(spark):
    values = [(1, y, w, v, Decimal(n)) for y in (2020, 2021, 2022, 2023) for w in (1, 2) for v, n in (("temp_media", 25 + y % 4), ("precipitation_sum", 10 * w), ("humedad_relativa_media", 60))]
    return spark.createDataFrame(values, "region int, anio int, semana int, variable string, valor decimal(10,3)")


def test_suitability_of_week(spark):
    corpus = (2020, 2021, 2022, 2023)
    got = {r.codigo: r for r in E.suitability_of_week(weekly(spark), regions(spark), corpus, 2, 2021).collect()}
    assert 0 < got["SV-A"].iv < 1 and got["SV-A"].anomaly_sigma is not None and got["SV-A"].nota is None
    assert got["SV-B"].iv is None and got["SV-B"].nota == E.NOTE_NO_WEATHER
    band = E.suitability_of_region(weekly(spark), regions(spark), corpus, 2021, "SV-A").orderBy("semana").collect()
    assert [b.semana for b in band] == [1, 2] and band[1].iv_real == got["SV-A"].iv
    assert band[0].p25_baseline <= band[0].mediana_baseline <= band[0].p75_baseline


def test_summaries_count_zero_for_regions_without_rows(spark):
    got = {r.codigo: (r.notificado_total, r.semanas_con_dato) for r in E.notified_cases(regions(spark), fact(spark)).collect()}
    assert got["SV-A"][1] == 15 and got["SV-B"] == (0, 0) and got["SV-C"] == (0, 0)
    cases = {r.codigo: r for r in E.regional_cases(regions(spark), fact(spark), "f").collect()}
    assert cases["SV-B"].probable_total == 2 and cases["SV-B"].semanas_con_dato_probable == 2
    assert cases["SV-C"].probable_total == 0 and cases["SV-C"].primer_anio is None


def test_notified_series_has_no_invented_weeks(spark):
    rows = E.notified_series(regions(spark), fact(spark), "SV-A").filter("anio = 2019").collect()
    assert [list(p) for p in rows[0].serie] == [[9, 11], [10, 12], [11, 13]]
    assert E.notified_series(regions(spark), fact(spark), "SV-C").count() == 0


def test_one_customer_with_a_third_of_all_orders(spark, tmp_path):
    n = 60_000
    ids = spark.range(n)
    customer = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000)
    day = F.expr("timestamp_ntz'1995-01-01 00:00:00'") + F.make_dt_interval((F.col("id") % 2000).cast("int"))
    status = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 3 + 1).cast("int"))
    ids.select(F.col("id").alias("o_orderkey"), customer.alias("o_custkey"), status.alias("o_orderstatus"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    for build in (A.obs, A.facts):
        assert build(spark, str(tmp_path)).agg(F.sum("conteo")).first()[0] == n
    plan = A.obs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("partial_count")
