"""Weather, suitability, anomaly, season and feature queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from checks.base import BASE_YEARS, LOO, check, history, median, observed, pct, view
from checks.baselines import base, national
from checks.relational import lab_series
from weekwatch.functions import calendar as cal
from weekwatch.functions import suitability as S
from weekwatch.operators import anomaly, channel, features, pools, ranking, season, summary, weekly
from weekwatch.plans import adapters as A
from weekwatch.plans import lead_time
from weekwatch.session import stored

VARS = A.VARIABLES
VAR_LIST = ", ".join(VARS)
SUM_LIST = "('precipitation_sum', 'precipitation_hours')"
CORPUS = tuple(range(1995, 2002))

view(
    "dia",
    "SELECT * REPLACE (CASE WHEN precipitation_sum IS NOT NULL THEN precipitation_hours END AS precipitation_hours) FROM daily",
)
view("dia_largo", f"SELECT region, fecha, variable, m FROM dia UNPIVOT (m FOR variable IN ({VAR_LIST}))")
_START = "(fecha - CAST(dayofweek(fecha) AS INTEGER))"
view(
    "semanal_m",
    f"""SELECT region, CAST(year(f + 3) AS INTEGER) AS anio, CAST((dayofyear(f + 3) - 1) // 7 + 1 AS INTEGER) AS semana,
        variable, CAST(CASE WHEN variable IN {SUM_LIST} THEN s ELSE (2 * s + n) // (2 * n) END AS BIGINT) AS m
    FROM (SELECT region, {_START} AS f, variable, sum(m)::BIGINT AS s, count(*) AS n FROM dia_largo GROUP BY ALL)""",
)
view("semanal", "SELECT region, anio, semana, variable, m / 1000.0::DOUBLE AS valor FROM semanal_m")
_S = ", ".join(f"sum({v})::DOUBLE / 1000 AS s_{v}, count({v}) AS n_{v}" for v in VARS)
_V = ", ".join(f"s_{v} AS {v}" if v in A.ACCUMULATIVE else f"s_{v} / n_{v} AS {v}" for v in VARS)
view(
    "completa",
    f"""SELECT region, CAST(year(fecha + 3) AS INTEGER) AS anio, CAST((dayofyear(fecha + 3) - 1) // 7 + 1 AS INTEGER) AS semana,
        fecha, {_V} FROM (SELECT region, {_START} AS fecha, {_S} FROM dia GROUP BY ALL)
    WHERE least({', '.join(f'n_{v}' for v in VARS)}) >= 5""",
)
view(
    "clima_nac",
    """SELECT anio, semana, variable, (sum(m)::DOUBLE / 1000) / count(*) AS valor, count(*) AS n_regiones
    FROM semanal_m GROUP BY ALL""",
)
view(
    "nac_ancho",
    f"""SELECT anio, semana, CAST(date_diff('day', DATE '1970-01-04', fecha_inicio) // 7 AS INTEGER) AS indice,
        {', '.join(f"max(valor) FILTER (variable = '{v}') AS {v}" for v in VARS)}
    FROM clima_nac JOIN cal USING (anio, semana) GROUP BY ALL""",
)


def guarded(spark, d, ranges=None):
    return weekly.guard_false_zero(A.daily_payload(spark, d, ranges))


def weekly_wide(spark, d, ranges=None):
    return weekly.weekly_wide(guarded(spark, d, ranges), ["region"], VARS, A.ACCUMULATIVE)


def weekly_long(spark, d):
    return weekly.weekly_long(guarded(spark, d), ["region"], VARS, A.ACCUMULATIVE)


def complete(spark, d):
    return weekly.weekly_complete(guarded(spark, d), ["region"], VARS, A.ACCUMULATIVE)


def with_index(df):
    return df.withColumn("indice", cal.week_index(cal.start_of(F.col("anio"), F.col("semana"))))


def national_wide(spark, d):
    return with_index(weekly.national_wide(weekly_wide(spark, d), VARS).drop(*[f"n_{v}" for v in VARS]))


@check(
    "F7_false_zero_guard",
    "SELECT region, fecha, precipitation_sum / 1000.0::DOUBLE AS precipitation_sum, precipitation_hours / 1000.0::DOUBLE AS precipitation_hours FROM dia",
)
def f7(spark, d):
    return guarded(spark, d).select(
        "region", "fecha", F.col("precipitation_sum").cast("double").alias("precipitation_sum"),
        F.col("precipitation_hours").cast("double").alias("precipitation_hours"),
    )


@check("A1_daily_to_weekly", "SELECT * FROM semanal")
def a1(spark, d):
    return weekly_long(spark, d).withColumn("valor", F.col("valor").cast("double"))


@check("A2_weekly_with_day_floor", "SELECT * FROM completa")
def a2(spark, d):
    return complete(spark, d)


view("idx_semanal", "SELECT c.anio, c.semana, i.anom FROM cal c JOIN idx i ON i.anio = year(c.fecha_inicio) AND i.mes = month(c.fecha_inicio)")


@check(
    "A3_national_mean",
    """SELECT * FROM clima_nac UNION ALL SELECT anio, semana, 'oni_anom', anom, NULL FROM idx_semanal""",
)
def a3(spark, d):
    from weekwatch.operators import calendar as C

    index = C.monthly_to_weekly(A.monthly_index(spark, d), A.calendar(spark, d)).dropna(subset=["anom"])
    level0 = index.select("anio", "semana", F.lit("oni_anom").alias("variable"), F.col("anom").alias("valor"))
    own = level0.select("anio", "semana", "variable", F.col("valor").cast("double").alias("valor"), F.lit(None).cast("bigint").alias("n_regiones"))
    return weekly.national_rows(weekly.national_wide(weekly_wide(spark, d), VARS), VARS).unionByName(own)


def n_regions(spark, d):
    return A.regions(spark, d).agg(F.count(F.lit(1))).scalar()


@check("A4_strict_national_mean", "SELECT * FROM clima_nac WHERE n_regiones = (SELECT count(*) FROM nation)")
def a4(spark, d):
    return weekly.strict_national_mean(weekly_long(spark, d), n_regions(spark, d))[0]


@check(
    "A4_incomplete_groups",
    "SELECT anio, semana, variable, n_regiones FROM clima_nac WHERE n_regiones <> (SELECT count(*) FROM nation)",
)
def a4_short(spark, d):
    return weekly.strict_national_mean(weekly_long(spark, d), n_regions(spark, d))[1]


_WIDE3 = ", ".join(f"max(valor) FILTER (variable = '{v}') AS {v}" for v in anomaly.REQUIRED)
view("tres", f"SELECT region, anio, semana, {_WIDE3} FROM semanal GROUP BY ALL")


@check(
    "F6_complete_weeks",
    "SELECT * FROM tres WHERE temp_media IS NOT NULL AND precipitation_sum IS NOT NULL AND humedad_relativa_media IS NOT NULL",
)
def f6(spark, d):
    return weekly.known(weekly_wide(spark, d), anomaly.REQUIRED)


def three(spark, d):
    return weekly.known(weekly_wide(spark, d), anomaly.REQUIRED, complete=False)


view(
    "lluvia",
    """SELECT t.*, t.precipitation_sum + coalesce(p.precipitation_sum, 0) AS lluvia_2s FROM tres t
    LEFT JOIN tres p ON p.region = t.region AND p.anio = t.anio AND p.semana = t.semana - 1""",
)
# the scale makes the greatest product on a fine grid of temperatures 1; worked out by SQL, not taken from the library
_PRODUCT = "(t / 1000.0::DOUBLE) * (t / 1000.0::DOUBLE - 16) * sqrt(38 - t / 1000.0::DOUBLE)"
_C = f"(SELECT 1 / max({_PRODUCT}) FROM (SELECT unnest(generate_series(16000, 38000)) AS t))"
view(
    "formulas",
    f"""SELECT *, CASE WHEN temp_media <= 16 OR temp_media >= 38 THEN 0::DOUBLE WHEN temp_media IS NOT NULL THEN
            greatest(0, least(1, {_C}::DOUBLE * temp_media * (temp_media - 16) * sqrt(38 - temp_media))) END AS termica,
        1 / (1 + exp(-0.1::DOUBLE * (lluvia_2s - 30))) AS hidrica, least(1, greatest(0, humedad_relativa_media / 50)) AS humedad
    FROM lluvia""",
)
view("idoneidad", "SELECT region, anio, semana, termica * (0.3::DOUBLE + 0.7::DOUBLE * hidrica) * humedad AS iv FROM formulas WHERE termica IS NOT NULL AND hidrica IS NOT NULL AND humedad IS NOT NULL")


@check("W3_two_week_rain", "SELECT region, anio, semana, round(lluvia_2s, 6) AS lluvia_2s FROM lluvia")
def w3(spark, d):
    rain = anomaly.two_week_rain(None, ["region"])
    return three(spark, d).select("region", "anio", "semana", F.round(rain, 6).alias("lluvia_2s"))


@check("X1_thermal_suitability", "SELECT region, anio, semana, round(termica, 6) AS termica FROM formulas")
def x1(spark, d):
    return three(spark, d).select("region", "anio", "semana", F.round(S.thermal(F.col("temp_media")), 6).alias("termica"))


@check("X2_rain_suitability", "SELECT region, anio, semana, round(hidrica, 6) AS hidrica FROM formulas")
def x2(spark, d):
    rain = three(spark, d).withColumn("lluvia_2s", anomaly.two_week_rain(None, ["region"]))
    return rain.select("region", "anio", "semana", F.round(S.rain(F.col("lluvia_2s")), 6).alias("hidrica"))


@check("X3_humidity_ramp", "SELECT region, anio, semana, round(humedad, 6) AS humedad FROM formulas")
def x3(spark, d):
    ramp = S.humidity(F.col("humedad_relativa_media"))
    return three(spark, d).select("region", "anio", "semana", F.round(ramp, 6).alias("humedad"))


def iv_series(spark, d):
    return anomaly.suitability_series(three(spark, d), ["region"])


@check("X4_suitability_index", "SELECT region, anio, semana, round(iv, 6) AS iv FROM idoneidad")
def x4(spark, d):
    return iv_series(spark, d).withColumn("iv", F.round("iv", 6))


@check(
    "X8_moist_heat_inputs",
    """SELECT region, anio, semana, round(7 * greatest(least(temp_media, 35) - 16, 0), 6) AS grados_dia,
        round(CASE WHEN temp_media > 34.6 THEN 0 ELSE greatest(least(temp_media, 34.6::DOUBLE) - 17.8::DOUBLE, 0) * humedad_relativa_media / 100 END, 6) AS calor_humedo,
        temp_media BETWEEN 27 AND 29.5 AND humedad_relativa_media > 75 AS optima FROM completa""",
)
def x8(spark, d):
    t, h = F.col("temp_media"), F.col("humedad_relativa_media")
    return complete(spark, d).select(
        "region", "anio", "semana", F.round(S.degree_days(t), 6).alias("grados_dia"),
        F.round(S.moist_heat(t, h), 6).alias("calor_humedo"), S.optimum(t, h).alias("optima"),
    )


@check(
    "X9_output_rounding",
    """SELECT region, anio, semana, round(iv, 4) AS iv4, round_even(m / 1000.0::DOUBLE, 1) AS lluvia1
    FROM idoneidad JOIN (SELECT * FROM semanal_m WHERE variable = 'precipitation_sum') USING (region, anio, semana)""",
)
def x9(spark, d):
    iv = iv_series(spark, d)
    rain = three(spark, d).dropna(subset=["precipitation_sum"]).select(
        "region", "anio", "semana", F.bround("precipitation_sum", 1).alias("lluvia1")
    )
    return iv.join(rain, ["region", "anio", "semana"]).select(
        "region", "anio", "semana", F.round("iv", 4).alias("iv4"), "lluvia1"
    )


view("serie_iv", "SELECT region, anio, semana, iv AS valor FROM idoneidad")
view("hist_iv", history("serie_iv", "region", 0, "h.anio <> t.anio"))
view(
    "base_iv",
    f"""SELECT *, CASE WHEN n_obs >= 3 THEN {median('pool')} END AS mediana,
        CASE WHEN n_obs >= 3 THEN sqrt(list_sum([(x - media) * (x - media) for x in pool]) / (n_obs - 1)) END AS desviacion,
        {pct('pool', 0.25)} AS p25, {pct('pool', 0.75)} AS p75
    FROM (SELECT *, list_sum(pool) / n_obs AS media FROM hist_iv)""",
)
view("anomalia", "SELECT *, CASE WHEN desviacion >= 1e-9 THEN (valor - mediana) / desviacion END AS z FROM base_iv")


def anomalies(spark, d):
    return anomaly.same_week_anomaly(iv_series(spark, d), ["region"], "iv", CORPUS)


@check(
    "P13_same_week_baseline",
    """SELECT region, anio, semana, n_obs, round(mediana, 6) AS mediana, round(desviacion, 6) AS desviacion,
        round(p25, 6) AS p25, round(p75, 6) AS p75 FROM anomalia""",
)
def p13(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return anomalies(spark, d).select(
        "region", "anio", "semana", "n_obs", r("mediana"), r("desviacion"), r("p25"), r("p75")
    )


@check("P14_continuous_z", "SELECT region, anio, semana, round(z, 5) AS z FROM anomalia")
def p14(spark, d):
    return anomalies(spark, d).select("region", "anio", "semana", F.round("z", 5).alias("z"))


@check(
    "P18_fixed_breaks",
    """SELECT region, anio, semana, CASE WHEN z IS NULL THEN NULL WHEN z <= -1.5 THEN 0 WHEN z <= -0.5 THEN 1
        WHEN z <= 0.5 THEN 2 WHEN z <= 1.5 THEN 3 ELSE 4 END AS tramo FROM anomalia""",
)
def p18(spark, d):
    from weekwatch.functions.classify import ANOMALY_BREAKS, first_break

    return anomalies(spark, d).select("region", "anio", "semana", first_break(F.col("z"), ANOMALY_BREAKS).alias("tramo"))


_DECILES = ", ".join(f"count(*) FILTER (least(CAST(floor(iv * 10) AS BIGINT), 9) = {i}) AS decil_{i}" for i in range(10))


@check(
    "A14_degeneracy_check",
    f"""SELECT count(*) AS n, round(avg(iv), 6) AS media, round(stddev_samp(iv), 6) AS desviacion, round(min(iv), 6) AS minimo,
        round(max(iv), 6) AS maximo, round(count(*) FILTER (iv < 0.01) / count(*), 6) AS fraccion_cero,
        round(count(*) FILTER (iv > 0.99) / count(*), 6) AS fraccion_uno, {_DECILES}, round(median(iv), 6) AS mediana FROM idoneidad""",
)
def a14(spark, d):
    iv = iv_series(spark, d)
    stats = anomaly.degeneracy(iv, "iv").withColumn("mediana", ranking.exact_median(iv, "iv").scalar())
    exact = ["media", "desviacion", "minimo", "maximo", "fraccion_cero", "fraccion_uno", "mediana"]
    return stats.withColumns({c: F.round(c, 6) for c in exact})


@check(
    "A17_weeks_in_every_region",
    """SELECT anio, semana, round(avg(iv), 6) AS iv FROM idoneidad GROUP BY ALL
    HAVING count(DISTINCT region) = (SELECT count(*) FROM nation)""",
)
def a17(spark, d):
    common = weekly.common_to_all(iv_series(spark, d), "region", n_regions(spark, d), "iv")
    return common.withColumn("iv", F.round("iv", 6))


@check(
    "A19_entities_without_weather",
    """SELECT region, count(*) AS semanas, 0::BIGINT AS con_clima FROM (SELECT DISTINCT region, anio, semana FROM obs) o
    LEFT JOIN (SELECT *, 1 AS hay FROM completa WHERE region % 2 = 0) c USING (region, anio, semana) GROUP BY region HAVING count(hay) = 0""",
)
def a19_weather(spark, d):
    weeks = A.obs(spark, d).select("region", "anio", "semana").distinct()
    even = complete(spark, d).filter(F.col("region") % 2 == 0)
    return summary.without_coverage(weeks, even, "region")


_LAGS = " ".join(f"LEFT JOIN nac_ancho l{k} ON l{k}.indice = t.indice - {k}" for k in (1, 2, 3, 4))
_COLS = ", ".join(
    f"l1.{v} AS {v}_lag1, l2.{v} AS {v}_lag2, (l4.{v} + l3.{v} + l2.{v} + l1.{v}) / 4 AS {v}_media_movil4" for v in VARS
)
view("rezagos", f"SELECT t.anio, t.semana, {_COLS} FROM nac_ancho t {_LAGS}")
NAMES = features.feature_names(VARS)


def rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def sql_rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def feature_rows(spark, d):
    return features.lagged(national_wide(spark, d), [], VARS).select("anio", "semana", *NAMES)


_W1 = [n for n in NAMES if "lag" in n]
_W2 = [n for n in NAMES if "media_movil" in n]


@check("W1_lags", f"SELECT anio, semana, {', '.join(_W1)} FROM rezagos")
def w1(spark, d):
    return feature_rows(spark, d).select("anio", "semana", *_W1)


@check("W2_trailing_mean", f"SELECT anio, semana, {', '.join(_W2)} FROM rezagos")
def w2(spark, d):
    return feature_rows(spark, d).select("anio", "semana", *_W2)


view(
    "completa_i",
    "SELECT *, CAST(date_diff('day', DATE '1970-01-04', fecha) // 7 AS INTEGER) AS indice FROM completa",
)
_L8 = " ".join(f"JOIN completa_i l{k} ON l{k}.region = t.region AND l{k}.indice = t.indice - {k}" for k in range(1, 9))
_OK = [f"(l{k}.temp_media BETWEEN 17.8 AND 34.6)" for k in range(1, 9)]
_STREAK = " + ".join("CAST(" + " AND ".join(_OK[: k + 1]) + " AS INTEGER)" for k in range(8))


def _four(expr: str) -> str:
    return "(" + " + ".join(expr.replace("@", f"l{k}.") for k in (1, 2, 3, 4)) + ")"


view(
    "mecanicas",
    f"""SELECT t.region, t.anio, t.semana, CAST({_STREAK} AS DOUBLE) AS racha_termica_transmision_8s,
        {_four('7 * greatest(least(@temp_media, 35) - 16, 0)')} AS grados_dia_desarrollo_4s,
        CAST({_four('CAST(@temp_media BETWEEN 27 AND 29.5 AND @humedad_relativa_media > 75 AS INTEGER)')} AS DOUBLE) AS semanas_optimas_temp_humedad_4s,
        {_four('CASE WHEN @temp_media > 34.6 THEN 0 ELSE greatest(least(@temp_media, 34.6::DOUBLE) - 17.8::DOUBLE, 0) * @humedad_relativa_media / 100 END')} / 4 AS interaccion_termohigrometrica_4s,
        {_four('(@temp_max - @temp_min)')} / 4 AS amplitud_termica_media_4s,
        {_four('@precipitation_hours')} AS duracion_lluvia_4s,
        greatest(l1.precipitation_sum - (l2.precipitation_sum + l3.precipitation_sum + l4.precipitation_sum) / 3, 0) AS pulso_seco_humedo_1s
    FROM completa_i t {_L8}""",
)


def mechanistic(spark, d):
    return features.mechanistic(with_index(complete(spark, d)), ["region"])


@check(
    "W14_mechanistic_features",
    f"SELECT region, anio, semana, {sql_rounded(features.MECHANISTIC)} FROM mecanicas",
)
def w14(spark, d):
    rows = mechanistic(spark, d).dropna(subset=list(features.MECHANISTIC))
    return rounded(rows.select("region", "anio", "semana", *features.MECHANISTIC), features.MECHANISTIC)


_PROFILE = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, round(min({v}), 5) AS minimo, round(max({v}), 5) AS maximo, round(avg({v}), 5) AS media, "
    f"count(DISTINCT round({v}, 6)) AS valores_unicos FROM mecanicas HAVING count({v}) > 0" for v in features.MECHANISTIC
)


@check("A18_feature_profile", _PROFILE)
def a18(spark, d):
    rows = rounded(mechanistic(spark, d), features.MECHANISTIC)
    prof = features.profile(rows, features.MECHANISTIC)
    return prof.withColumns({c: F.round(c, 5) for c in ("minimo", "maximo", "media")})


view(
    "rezagos_casos",
    """SELECT t.anio, t.semana, l1.valor AS casos_lag1, l2.valor AS casos_lag2, (l4.valor + l3.valor + l2.valor + l1.valor) / 4 AS casos_media_movil4,
        CASE WHEN l1.anio = 1998 OR l2.anio = 1998 OR l3.anio = 1998 OR l4.anio = 1998 THEN 'rezago_casos_anio_excluido'
             WHEN l1.anio IS NULL OR l2.anio IS NULL OR l3.anio IS NULL OR l4.anio IS NULL THEN 'sin_historia_casos' END AS motivo
    FROM cal c JOIN serie_nat t USING (anio, semana) """
    + " ".join(
        f"LEFT JOIN cal c{k} ON c{k}.fecha_inicio = c.fecha_inicio - {7 * k} LEFT JOIN serie_nat l{k} ON l{k}.anio = c{k}.anio AND l{k}.semana = c{k}.semana"
        for k in (1, 2, 3, 4)
    ),
)


@check("W15_case_lags", "SELECT * FROM rezagos_casos")
def w15(spark, d):
    rows = features.case_lags(with_index(national(spark, d)), [], [A.EXCLUDED_YEAR])
    return rows.select("anio", "semana", "casos_lag1", "casos_lag2", "casos_media_movil4", "motivo")


@check(
    "F4_excluded_year_scopes",
    """SELECT 'objetivo' AS ambito, count(*) FILTER (anio <> 1998) AS filas FROM serie_nat
    UNION ALL SELECT 'pool', count(*) FILTER (n_obs >= 6 AND anios_presentes >= 2 AND anio <> 1998) FROM hist_previa
    UNION ALL SELECT 'rezago', count(*) FILTER (motivo IS NULL AND anio <> 1998) FROM rezagos_casos""",
)
def f4(spark, d):
    series = national(spark, d)
    target = F.col("anio") != A.EXCLUDED_YEAR
    scopes = {
        "objetivo": series.filter(target),
        "pool": pools.observed_cells(series, [], pools.earlier_than([A.EXCLUDED_YEAR])).filter(
            target & pools.sufficient(6, 2)
        ),
        "rezago": features.case_lags(with_index(series), [], [A.EXCLUDED_YEAR]).filter(
            target & F.col("motivo").isNull()
        ),
    }
    counted = [
        rows.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("ambito"), "filas")
        for name, rows in scopes.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


view(
    "dataset",
    f"""SELECT e.* EXCLUDE (motivo), r.* EXCLUDE (anio, semana), CASE WHEN e.anio = 1998 THEN 'anio_excluido'
        WHEN etiqueta IS NULL THEN 'sin_suficiencia_etiqueta'
        WHEN {' OR '.join(f'{n} IS NULL' for n in NAMES)} THEN 'sin_historia_climatica' END AS motivo
    FROM etiquetas_retro e LEFT JOIN rezagos r USING (anio, semana)""",
)


def training_rows(spark, d):
    labels = channel.retrospective_labels(national(spark, d), [], A.BASE_YEARS).drop("claves")
    return features.training_set(labels, feature_rows(spark, d), NAMES, [A.EXCLUDED_YEAR])


@check(
    "Q10_training_set",
    f"""SELECT anio, semana, valor, n_obs, anios_presentes, corte_inferior, corte_superior, etiqueta, {', '.join(NAMES)}
    FROM dataset WHERE motivo IS NULL""",
)
def q10(spark, d):
    return training_rows(spark, d).filter(F.col("motivo").isNull()).drop("motivo")


@check(
    "F8_discards_observed",
    """SELECT count(*) AS candidatas, count(*) FILTER (motivo IS NULL) AS filas_finales, count(*) FILTER (motivo = 'anio_excluido') AS anio_excluido,
        count(*) FILTER (motivo = 'sin_suficiencia_etiqueta') AS sin_suficiencia_etiqueta,
        count(*) FILTER (motivo = 'sin_historia_climatica') AS sin_historia_climatica FROM dataset""",
)
def f8_observed(spark, d):
    """Counted by the job that writes the usable rows."""
    seen = Observation("descartes")
    stored(features.usable_rows(training_rows(spark, d), ["anio_excluido", "sin_suficiencia_etiqueta", "sin_historia_climatica"], seen))
    return observed(spark, seen)


@check(
    "F8_labelled_discards",
    "SELECT coalesce(motivo, 'filas_finales') AS motivo, count(*) AS filas FROM dataset GROUP BY 1",
)
def f8(spark, d):
    return features.discard_counts(training_rows(spark, d))


@check(
    "A22_dataset_dimensions",
    """SELECT min(anio) AS primer_anio, max(anio) AS ultimo_anio, count(*) AS candidatas, count(*) FILTER (motivo IS NULL) AS filas,
        count(*) FILTER (motivo IS NULL AND etiqueta = 'alto') AS altas,
        count(DISTINCT anio) FILTER (motivo IS NULL AND etiqueta = 'alto') AS anios_con_alta FROM dataset""",
)
def a22(spark, d):
    usable = F.col("motivo").isNull()
    high = usable & (F.col("etiqueta") == "alto")
    return training_rows(spark, d).agg(
        F.min("anio").alias("primer_anio"), F.max("anio").alias("ultimo_anio"), F.count(F.lit(1)).alias("candidatas"),
        F.count_if(usable).alias("filas"), F.count_if(high).alias("altas"),
        F.count_distinct(F.when(high, F.col("anio"))).alias("anios_con_alta"),
    )


@check(
    "A15_total_vs_high_weeks",
    f"""SELECT region, clase, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS r, anios, anios_con_alta FROM (
        SELECT region, clase, corr(total, altas) AS r, count(*) AS anios, count(*) FILTER (altas > 0) AS anios_con_alta
        FROM (SELECT region, clase, anio, sum(valor) AS total, (count(*) FILTER (clase_p75_p90 = 'alto'))::DOUBLE AS altas
              FROM canal_reg GROUP BY ALL) GROUP BY ALL)""",
)
def a15(spark, d):
    from checks.baselines import KEYS, regional

    rows = base(regional(spark, d))
    cells = channel.endemic_channel(rows, KEYS, A.BASE_YEARS).withColumnRenamed("clase_p75_p90", "etiqueta")
    return summary.yearly_correlation(rows, cells, KEYS).withColumn("r", F.round("r", 6))


# --- season ---------------------------------------------------------------

view("serie_lab", f"SELECT region, anio, semana, sum(conteo)::DOUBLE AS valor FROM obs WHERE clase <> 'notificado' AND anio IN {BASE_YEARS} GROUP BY ALL")
view("hist_lab", history("serie_lab", "region", 1, LOO))
view("canal_lab", f"SELECT *, {pct('pool', 0.75)} AS p75 FROM hist_lab")
view(
    "inicios",
    "SELECT region, anio, min(semana) FILTER (valor > p75) AS semana_inicio FROM canal_lab WHERE p75 IS NOT NULL GROUP BY ALL",
)
view(
    "alertas",
    """SELECT region, anio, min(semana) FILTER (z >= 0.8 AND z2 >= 0.8) AS semana_alerta, max(z) AS z_maximo
    FROM (SELECT *, lead(z) OVER (PARTITION BY region, anio ORDER BY semana) AS z2 FROM anomalia) GROUP BY ALL""",
)


def starts(spark, d):
    cells = channel.endemic_channel(lab_series(spark, d), ["region"], A.BASE_YEARS)
    return season.season_start(cells, ["region"])


def alerts(spark, d):
    return season.first_alert(anomalies(spark, d), ["region"], threshold=0.8)


@check("W12_season_start", "SELECT * FROM inicios")
def w12(spark, d):
    return starts(spark, d)


@check(
    "W12_national_season_start",
    "SELECT anio, min(semana) FILTER (valor > p75) AS semana_inicio FROM canal WHERE suficiente GROUP BY anio",
)
def w12_national(spark, d):
    cells = channel.endemic_channel(national(spark, d), [], A.BASE_YEARS)
    return season.season_start(cells, [], require_sufficient=True)


@check("W13_first_alert", "SELECT region, anio, semana_alerta, round(z_maximo, 5) AS z_maximo FROM alertas")
def w13(spark, d):
    return alerts(spark, d).withColumn("z_maximo", F.round("z_maximo", 5))


view(
    "adelantos",
    f"""SELECT region, anio, semana_inicio, semana_alerta, semana_inicio - semana_alerta AS adelanto,
        CASE WHEN semana_inicio = 1 THEN '{season.NOTE_DEGENERATE}' WHEN semana_inicio IS NULL THEN '{season.NOTE_NO_START}'
             WHEN semana_alerta IS NULL THEN '{season.NOTE_NO_ALERT}' END AS nota
    FROM inicios LEFT JOIN alertas USING (region, anio)""",
)


def leads(spark, d):
    return season.lead_time(starts(spark, d), alerts(spark, d), ["region"])


@check("W16_lead_time", "SELECT * FROM adelantos")
def w16(spark, d):
    return leads(spark, d)


view("iv_nacional", "SELECT anio, semana, avg(iv) AS valor FROM idoneidad GROUP BY ALL HAVING count(DISTINCT region) = (SELECT count(*) FROM nation)")
view("hist_iv_nacional", history("iv_nacional", "", 0, "h.anio <> t.anio"))
view(
    "anomalia_nacional",
    f"""SELECT anio, semana, CASE WHEN n_obs >= 3 AND desviacion >= 1e-9 THEN (valor - {median('pool')}) / desviacion END AS z
    FROM (SELECT *, CASE WHEN n_obs >= 3 THEN sqrt(list_sum([(x - media) * (x - media) for x in pool]) / (n_obs - 1)) END AS desviacion
          FROM (SELECT *, list_sum(pool) / n_obs AS media FROM hist_iv_nacional))""",
)
view(
    "alertas_nacionales",
    """SELECT anio, min(semana) FILTER (z >= 0.8 AND z2 >= 0.8) AS semana_alerta
    FROM (SELECT *, lead(z) OVER (PARTITION BY anio ORDER BY semana) AS z2 FROM anomalia_nacional) GROUP BY anio""",
)


@check(
    "W16_national_lead_time",
    f"""SELECT anio, semana_inicio, semana_alerta, semana_inicio - semana_alerta AS adelanto,
        CASE WHEN semana_inicio IS NULL THEN '{season.NOTE_NO_START}' WHEN semana_alerta IS NULL THEN '{season.NOTE_NO_ALERT}' END AS nota
    FROM (SELECT anio, min(semana) FILTER (valor > p75) AS semana_inicio FROM canal WHERE suficiente GROUP BY anio) LEFT JOIN alertas_nacionales USING (anio)""",
)
def w16_national(spark, d):
    return lead_time.national(iv_series(spark, d), n_regions(spark, d), national(spark, d), CORPUS, A.BASE_YEARS, threshold=0.8)


@check(
    "W16_lead_time_summary",
    f"""SELECT region, count(*) AS medibles, {median('list(adelanto::DOUBLE ORDER BY adelanto)')} AS mediana,
        {pct('list(adelanto::DOUBLE ORDER BY adelanto)', 0.25)} AS q1, {pct('list(adelanto::DOUBLE ORDER BY adelanto)', 0.75)} AS q3,
        count(*) FILTER (adelanto > 0) / count(*) AS fraccion_positiva
    FROM adelantos WHERE nota IS NULL GROUP BY region""",
)
def w16_summary(spark, d):
    return season.lead_time_summary(leads(spark, d), ["region"])
