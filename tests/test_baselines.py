from pyspark.sql import functions as F

from weekwatch.operators import anomaly, channel, pools, pressure, season

YEARS = (2018, 2019, 2021, 2022, 2023)


def series(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], "region string, anio int, semana int, valor double")


def spread(value_of, years=YEARS, weeks=(9, 10, 11)):
    return [(y, w, float(value_of(y, w))) for y in years for w in weeks]


def cell(df, year, week):
    return df.filter((F.col("anio") == year) & (F.col("semana") == week)).first()


def test_pressure_of_a_known_cell(spark):
    values = iter(range(1, 13))
    rows = [(y, w, float(next(values))) for y in (2018, 2019, 2021, 2022) for w in (9, 10, 11)] + [(2023, 10, 11.5)]
    got = cell(pressure.observed(series(spark, rows), ["region"], YEARS), 2023, 10)
    assert (got.percentil, got.categoria, got.p50_baseline, got.p75_baseline) == (95.5, "alta", 6.5, 9.2)
    assert (got.n_obs_baseline, got.anios_baseline, got.nota) == (12, 4, None)


def test_pressure_notes_and_their_order(spark):
    few = series(spark, spread(lambda y, w: w, years=(2018, 2019)))
    got = cell(pressure.of_year(few, ["region"], YEARS, 2023), 2023, 10)
    assert got.percentil is None and got.nota == pressure.NOTE_INSUFFICIENT
    enough = series(spark, spread(lambda y, w: w, years=(2018, 2019, 2021)))
    got = cell(pressure.of_year(enough, ["region"], YEARS, 2023), 2023, 10)
    assert got.casos_observados is None and got.nota == pressure.NOTE_MISSING


def test_own_year_and_year_outside_base_are_not_in_the_pool(spark):
    rows = series(spark, spread(lambda y, w: 1, years=YEARS) + [(2020, 10, 999.0)])
    got = cell(pools.observed_cells(rows, ["region"], pools.others_in(YEARS)), 2020, 10)
    assert got.pool == [1.0] * 15
    got = cell(pools.observed_cells(rows, ["region"], pools.others_in(YEARS)), 2023, 10)
    assert got.n_obs == 12 and got.anios_presentes == 4


def test_window_does_not_wrap(spark):
    rows = series(spark, spread(lambda y, w: w, weeks=(1, 2, 52, 53)))
    cells = pools.observed_cells(rows, ["region"], pools.others_in(YEARS))
    assert cell(cells, 2018, 1).pool == [1.0] * 4 + [2.0] * 4
    assert cell(cells, 2018, 53).pool == [52.0] * 4 + [53.0] * 4


def test_prospective_labels_ignore_the_future(spark):
    rows = spread(lambda y, w: y - 2010 + w, years=range(2014, 2024))
    spoiled = [(y, w, v + 1_000_000 if y >= 2022 else v) for y, w, v in rows]
    labels = lambda r: {
        (x.anio, x.semana): (x.corte_inferior, x.corte_superior, x.etiqueta)
        for x in channel.prospective_labels(series(spark, r), ["region"]).filter("anio < 2022").collect()
    }
    assert labels(rows) == labels(spoiled)
    retro = lambda r: cell(channel.retrospective_labels(series(spark, r), ["region"], tuple(range(2014, 2024))), 2015, 10).corte_superior
    assert retro(rows) != retro(spoiled)


def test_labels_carry_lineage_and_reason(spark):
    rows = series(spark, spread(lambda y, w: w, years=(2014, 2015, 2016, 2017, 2018)))
    labels = channel.prospective_labels(rows, ["region"], excluded=[2016])
    last = cell(labels, 2018, 10)
    assert last.motivo == channel.INSUFFICIENT and last.n_obs == 9
    assert {(c.anio, c.semana) for c in last.claves} == {(y, w) for y in (2014, 2015, 2017) for w in (9, 10, 11)}


def test_within_year_labels_need_a_complete_year(spark):
    full = [(2019, w, float(w)) for w in range(1, 53)]
    part = [(2020, w, float(w)) for w in range(1, 51)]
    labels = channel.within_year_labels(series(spark, full + part), ["region"])
    counts = {(r.anio, r.etiqueta): r["count"] for r in labels.groupBy("anio", "etiqueta").count().collect()}
    assert counts == {(2019, "bajo"): 26, (2019, "medio"): 13, (2019, "alto"): 13}


def test_zones_always_agree_with_classes(spark):
    rows = series(spark, [(y, w, float((y * 7 + w * 13) % 17)) for y in YEARS for w in range(1, 53)])
    cells = channel.endemic_channel(rows, ["region"], YEARS)
    assert cells.count() == 260 and channel.scheme_disagreements(cells).count() == 0


def test_same_week_grid_keeps_empty_cells_and_never_reaches_the_floor(spark):
    points = series(spark, [(y, 3, 0.0) for y in YEARS])
    grid = channel.same_week_channel(points, ["region"], YEARS)
    assert grid.count() == 52 * 5 and grid.filter("suficiente").count() == 0
    assert grid.filter("semana = 3").select("p75").distinct().collect()[0].p75 == 0.0
    assert grid.filter("semana = 4 AND p50 IS NULL AND n_obs = 0").count() == 5


def test_anomaly_needs_three_years_and_a_spread(spark):
    rows = series(spark, [(y, 1, v) for y, v in zip((2014, 2015, 2016, 2017), (1.0, 2.0, 3.0, 9.0))] + [(y, 2, 5.0) for y in (2014, 2015, 2016, 2017)] + [(2014, 3, 1.0), (2015, 3, 2.0)])
    got = anomaly.same_week_anomaly(rows, ["region"], "valor", (2014, 2015, 2016, 2017))
    assert cell(got, 2017, 1).z == 7.0
    assert cell(got, 2017, 2).z is None and cell(got, 2017, 2).desviacion == 0.0
    assert cell(got, 2014, 3).mediana is None


def test_alert_needs_two_listed_weeks_in_a_row(spark):
    rows = spark.createDataFrame(
        [("r", 2020, 1, 2.0), ("r", 2020, 2, 0.0), ("r", 2020, 5, 1.5), ("r", 2020, 9, 1.6), ("r", 2021, 1, 9.0), ("r", 2021, 2, None)],
        "region string, anio int, semana int, z double",
    )
    got = {r.anio: (r.semana_alerta, r.z_maximo) for r in season.first_alert(rows, ["region"]).collect()}
    assert got == {2020: (5, 2.0), 2021: (None, 9.0)}


def test_lead_time_notes(spark):
    starts = spark.createDataFrame([("r", 2018, 1), ("r", 2019, None), ("r", 2020, 20), ("r", 2021, 20)], "region string, anio int, semana_inicio int")
    alerts = spark.createDataFrame([("r", 2018, 5), ("r", 2020, 12)], "region string, anio int, semana_alerta int")
    leads = season.lead_time(starts, alerts, ["region"])
    got = {r.anio: (r.adelanto, r.nota) for r in leads.collect()}
    assert got == {2018: (-4, season.NOTE_DEGENERATE), 2019: (None, season.NOTE_NO_START), 2020: (8, None), 2021: (None, season.NOTE_NO_ALERT)}
    assert season.lead_time_summary(leads, ["region"]).first().mediana == 8.0
