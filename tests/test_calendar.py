import datetime as dt

from pyspark.sql import functions as F

from weekwatch.functions import calendar as cal
from weekwatch.operators import calendar as C
from weekwatch.operators import features


def _calendar(spark, first, last):
    return C.generate(spark.createDataFrame([(first, last)], "anio_min int, anio_max int"))


def test_week_counts_and_bounds(spark):
    rows = _calendar(spark, 2014, 2025).orderBy("fecha_inicio").collect()
    per_year = {}
    for r in rows:
        per_year.setdefault(r.anio, []).append(r.semana)
        assert r.fecha_fin - r.fecha_inicio == dt.timedelta(days=6)
        assert r.fecha_inicio.isoweekday() == 7
    assert {y for y, w in per_year.items() if len(w) == 53} == {2014, 2020, 2025}
    assert all(w == list(range(1, len(w) + 1)) for w in per_year.values())
    starts = [r.fecha_inicio for r in rows]
    assert all(b - a == dt.timedelta(days=7) for a, b in zip(starts, starts[1:]))
    assert starts[0] == dt.date(2013, 12, 29)


def test_every_day_belongs_to_its_calendar_week(spark):
    calendar = _calendar(spark, 2014, 2016)
    days = C.days_of(calendar)
    wrong = C.with_week(days, "fecha", "y", "w").filter("y <> anio OR w <> semana")
    assert wrong.count() == 0
    assert days.count() == calendar.count() * 7


def test_start_of_inverts_the_week_number(spark):
    calendar = _calendar(spark, 2013, 2021)
    assert calendar.filter(cal.start_of(F.col("anio"), F.col("semana")) != F.col("fecha_inicio")).count() == 0


def test_step_back_uses_the_real_year_length(spark):
    weeks = _calendar(spark, 2014, 2016).select("anio", F.col("fecha_inicio").alias("fecha"), F.lit("x").alias("k"))
    ordinal = C.ordinal_weeks(weeks, ["k"])
    back = C.step_back(ordinal, ["k"], 4).filter("semana = 4 AND anio > 2014").collect()
    assert {(r.anio, r.anio_previo, r.semana_previa) for r in back} == {(2015, 2014, 53), (2016, 2015, 52)}


def test_step_back_stops_at_a_missing_year(spark):
    weeks = _calendar(spark, 2014, 2016).filter("anio <> 2015").select("anio", F.col("fecha_inicio").alias("fecha"), F.lit("x").alias("k"))
    back = C.step_back(C.ordinal_weeks(weeks, ["k"]), ["k"], 1)
    assert back.filter("anio = 2016 AND semana = 1").first().anio_previo is None


def test_lags_cross_year_ends_and_stop_at_gaps(spark):
    rows = [(52, 1.0), (53, 2.0), (54, 3.0), (55, 4.0), (56, 5.0), (58, 7.0)]
    df = spark.createDataFrame(rows, "indice int, x double")
    out = {r.indice: r for r in features.lagged(df, [], ["x"]).collect()}
    assert (out[56].x_lag1, out[56].x_lag2, out[56].x_media_movil4) == (4.0, 3.0, 2.5)
    assert (out[58].x_lag1, out[58].x_lag2, out[58].x_media_movil4) == (None, 5.0, None)


def test_unmatched_days_are_reported(spark):
    calendar = _calendar(spark, 2014, 2014)
    days = spark.createDataFrame([(dt.date(2014, 3, 4),), (dt.date(2020, 1, 1),)], "fecha date")
    matched, missing = C.join_days(days, calendar)
    assert matched.count() == 1 and [r.fecha for r in missing.collect()] == [dt.date(2020, 1, 1)]
