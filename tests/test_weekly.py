import datetime as dt
from decimal import Decimal

from weekwatch.operators import features, weekly

VARS = ["temp_media", "precipitation_sum", "precipitation_hours"]
SUMS = ["precipitation_sum", "precipitation_hours"]


def days(spark, rows):
    schema = "region string, fecha date, temp_media decimal(10,3), precipitation_sum decimal(10,3), precipitation_hours decimal(10,3)"
    dec = lambda v: None if v is None else Decimal(str(v))
    start = dt.date(2021, 1, 3)
    return spark.createDataFrame([("r", start + dt.timedelta(days=i), *map(dec, r)) for i, r in enumerate(rows)], schema)


def test_false_zero_hours_are_unknown_and_true_zeros_stay(spark):
    df = weekly.guard_false_zero(days(spark, [(20, None, 0.0), (20, 0.0, 0.0)]))
    assert [r.precipitation_hours for r in df.orderBy("fecha").collect()] == [None, Decimal("0.000")]


def test_week_with_four_rain_days_is_dropped_whole(spark):
    full = [(20 + i, 1.0, 2.0) for i in range(7)]
    short = [(20, None if i < 3 else 1.0, 2.0) for i in range(7)]
    df = weekly.guard_false_zero(days(spark, full + short))
    got = weekly.weekly_complete(df, ["region"], VARS, SUMS).collect()
    assert [(r.anio, r.semana, r.temp_media, r.precipitation_sum, r.precipitation_hours) for r in got] == [(2021, 1, 23.0, 7.0, 14.0)]


def test_weekly_long_uses_mean_or_sum(spark):
    df = days(spark, [(20, 1.5, 2.0), (21, 2.5, 3.0), (21, None, None)])
    got = {r.variable: float(r.valor) for r in weekly.weekly_long(df, ["region"], VARS, SUMS).collect()}
    assert got == {"temp_media": 20.667, "precipitation_sum": 4.0, "precipitation_hours": 5.0}


def test_strict_mean_lists_incomplete_groups(spark):
    rows = [("a", 2020, 1, "t", Decimal("1")), ("b", 2020, 1, "t", Decimal("2")), ("a", 2020, 2, "t", Decimal("5"))]
    df = spark.createDataFrame(rows, "region string, anio int, semana int, variable string, valor decimal(10,3)")
    full, short = weekly.strict_national_mean(df, 2)
    assert [(r.semana, r.valor) for r in full.collect()] == [(1, 1.5)]
    assert [(r.semana, r.n_regiones) for r in short.collect()] == [(2, 1)]


def test_mechanistic_features_by_hand(spark):
    temps = [20.0, 36.0, 28.0, 28.0, 20.0, 28.0, 28.0, 30.0, 25.0]
    rows = [(i, t, 80.0, float(i), 2.0, t + 1, t - 1) for i, t in enumerate(temps)]
    df = spark.createDataFrame(
        rows, "indice int, temp_media double, humedad_relativa_media double, precipitation_sum double, precipitation_hours double, temp_max double, temp_min double"
    )
    out = {r.indice: r for r in features.mechanistic(df, []).collect()}
    assert out[7].racha_termica_transmision_8s is None
    last = out[8]
    assert last.racha_termica_transmision_8s == 6.0
    assert last.grados_dia_desarrollo_4s == 7 * (4 + 12 + 12 + 14)
    assert last.semanas_optimas_temp_humedad_4s == 2.0
    assert abs(last.interaccion_termohigrometrica_4s - (2.2 + 10.2 + 10.2 + 12.2) * 0.8 / 4) < 1e-9
    assert (last.amplitud_termica_media_4s, last.duracion_lluvia_4s, last.pulso_seco_humedo_1s) == (2.0, 8.0, 2.0)


def test_case_lags_report_excluded_years_before_gaps(spark):
    rows = [(2019, i, float(i)) for i in range(4)] + [(2020, 4, 9.0)] + [(2021, i, 1.0) for i in (5, 6, 7, 8, 10)]
    df = spark.createDataFrame([(y, i, v) for y, i, v in rows], "anio int, indice int, valor double")
    got = {r.indice: r.motivo for r in features.case_lags(df, [], [2020]).collect()}
    assert got[3] == "sin_historia_casos" and got[4] is None and got[8] == "rezago_casos_anio_excluido" and got[10] == "sin_historia_casos"
