"""User-level query checks, each over all regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BASE_YEARS, check, classes, median, pct, view
from checks.baselines import RANK
from checks.weather import CORPUS, weekly_wide
from weekwatch.operators import pressure
from weekwatch.plans import adapters as A
from weekwatch.plans import endpoints as E

WEEK, YEAR = 20, 2000


@check(
    "Q1_national_series",
    "SELECT fecha AS semana_inicio, anio, conteo FROM obs_nat ORDER BY anio, semana",
)
def q1(spark, d):
    return E.national_series(A.obs_national(spark, d), A.calendar(spark, d))


@check(
    "Q3_regional_cases",
    """SELECT r.nombre, r.codigo, coalesce(sum(conteo) FILTER (clasificacion = 'probable'), 0)::BIGINT AS probable_total,
        coalesce(sum(conteo) FILTER (clasificacion = 'confirmado'), 0)::BIGINT AS confirmado_total,
        count(DISTINCT anio || '-' || semana) FILTER (clasificacion = 'probable') AS semanas_con_dato_probable,
        min(anio) AS primer_anio, max(anio) AS ultimo_anio
    FROM regiones r LEFT JOIN facts f ON f.region = r.region AND f.fuente = '1-URGENT' GROUP BY ALL""",
)
def q3(spark, d):
    return E.regional_cases(A.regions(spark, d), A.facts(spark, d), "1-URGENT")


@check(
    "Q8_notified_cases",
    """SELECT r.nombre, r.codigo, coalesce(sum(conteo), 0)::BIGINT AS notificado_total, count(conteo) AS semanas_con_dato,
        min(anio) AS primer_anio, max(anio) AS ultimo_anio
    FROM regiones r LEFT JOIN facts f ON f.region = r.region AND f.clasificacion = 'notificado' GROUP BY ALL ORDER BY 1""",
)
def q8(spark, d):
    return E.notified_cases(A.regions(spark, d), A.facts(spark, d))


@check(
    "Q9_notified_series",
    """SELECT codigo, nombre, anio, '[' || string_agg('[' || semana || ',' || conteo || ']', ',' ORDER BY semana) || ']' AS serie
    FROM obs JOIN regiones USING (region) WHERE clase = 'notificado' GROUP BY ALL""",
)
def q9(spark, d):
    return E.notified_series(A.regions(spark, d), A.facts(spark, d)).withColumn("serie", F.to_json("serie"))


_Y = f"(1995, 1996, 1997, 1999, 2000, {YEAR})"


def _cells(grid: str) -> str:
    """Pressure of a (region, clase, semana) grid in YEAR by a theta join."""
    return f"""SELECT *, anios >= 3 AS basta, {RANK.replace('valor', 'obs_v')} AS rango FROM (SELECT *, coalesce(len(pool), 0) AS n,
            len([x for x in pool if x < obs_v]) AS menor, len([x for x in pool if x = obs_v]) AS igual FROM (
        SELECT g.region, g.clase, g.semana, max(o.valor) AS obs_v, list(h.valor ORDER BY h.valor) FILTER (h.valor IS NOT NULL) AS pool,
            count(h.valor) AS n_obs, count(DISTINCT h.anio) AS anios
        FROM ({grid}) g LEFT JOIN serie_reg o ON o.region = g.region AND o.clase = g.clase AND o.semana = g.semana AND o.anio = {YEAR}
        LEFT JOIN serie_reg h ON h.region = g.region AND h.clase = g.clase AND h.semana BETWEEN g.semana - 1 AND g.semana + 1
            AND h.anio IN {BASE_YEARS} AND h.anio <> {YEAR} GROUP BY ALL))"""


def _fields(serie: str) -> str:
    pick = lambda e: f"max({e}) FILTER (clase = '{serie}')"
    usable = "basta AND obs_v IS NOT NULL"
    cat = classes("obs_v", pct("pool", 0.5), pct("pool", 0.75), ("baja", "media", "alta"))
    parts = {
        "casos_observados": "obs_v",
        "percentil": f"CASE WHEN {usable} THEN round_even(rango::DOUBLE, 1) END",
        "categoria": f"CASE WHEN {usable} THEN {cat} END",
        "p50_baseline": f"CASE WHEN {usable} THEN round_even({pct('pool', 0.5)}, 1) END",
        "p75_baseline": f"CASE WHEN {usable} THEN round_even({pct('pool', 0.75)}, 1) END",
        "n_obs_baseline": "n_obs",
        "anios_baseline": "anios",
        "nota": f"CASE WHEN NOT basta THEN '{pressure.NOTE_INSUFFICIENT}' WHEN obs_v IS NULL THEN '{pressure.NOTE_MISSING}' END",
    }
    return ", ".join(f"{pick(e)} AS {serie}_{n}" for n, e in parts.items())


_WIDE = f"{_fields('probable')}, {_fields('confirmado')}"
view(
    "celdas_semana",
    _cells(f"SELECT region, unnest(['probable', 'confirmado']) AS clase, {WEEK} AS semana FROM regiones"),
)
view(
    "celdas_region",
    _cells(
        f"SELECT region, semana, unnest(['probable', 'confirmado']) AS clase FROM (SELECT DISTINCT region, semana FROM serie_reg "
        f"WHERE clase IN ('probable', 'confirmado') AND anio IN {_Y})"
    ),
)
view("presion_semana", f"SELECT region, codigo, nombre, semana, {YEAR} AS anio, {_WIDE} FROM celdas_semana JOIN regiones USING (region) GROUP BY ALL")


def week_pressure(spark, d):
    return E.pressure_of_week(A.facts(spark, d, E.pressure_days(A.BASE_YEARS, YEAR, WEEK)), A.regions(spark, d), A.BASE_YEARS, WEEK, YEAR)


@check("Q6_pressure_of_week", "SELECT * FROM presion_semana")
def q6(spark, d):
    return week_pressure(spark, d)


@check(
    "Q7_pressure_of_region",
    f"SELECT region, codigo, nombre, semana, {YEAR} AS anio, {_WIDE} FROM celdas_region JOIN regiones USING (region) GROUP BY ALL",
)
def q7(spark, d):
    return E.pressure_of_region(A.facts(spark, d, E.pressure_days(A.BASE_YEARS, YEAR)), A.regions(spark, d), A.BASE_YEARS, YEAR)


view(
    "banda",
    f"""SELECT *, CASE WHEN desviacion >= 1e-9 THEN (real - mediana) / desviacion END AS z FROM (
        SELECT *, CASE WHEN n >= 3 THEN {median('pool')} END AS mediana,
            CASE WHEN n >= 3 THEN sqrt(list_sum([(x - media) * (x - media) for x in pool]) / (n - 1)) END AS desviacion FROM (
        SELECT g.region, g.semana, max(o.iv) AS real, list(h.iv ORDER BY h.iv) FILTER (h.iv IS NOT NULL) AS pool, count(h.iv) AS n, avg(h.iv) AS media
        FROM (SELECT DISTINCT region, semana FROM idoneidad) g LEFT JOIN idoneidad o ON o.region = g.region AND o.semana = g.semana AND o.anio = {YEAR}
        LEFT JOIN idoneidad h ON h.region = g.region AND h.semana = g.semana AND h.anio <> {YEAR} GROUP BY ALL))""",
)
view(
    "idoneidad_semana",
    f"""SELECT r.region, r.codigo, r.nombre, round(real, 4) AS iv, CASE WHEN real IS NOT NULL THEN round(z, 4) END AS anomaly_sigma,
        CASE WHEN real IS NULL THEN '{E.NOTE_NO_WEATHER}' END AS nota FROM regiones r LEFT JOIN banda b ON b.region = r.region AND b.semana = {WEEK}""",
)


def week_suitability(spark, d):
    return E.suitability_of_week(weekly_wide(spark, d, E.suitability_days(CORPUS, WEEK)), A.regions(spark, d), CORPUS, WEEK, YEAR)


@check("Q4_suitability_of_week", "SELECT * FROM idoneidad_semana")
def q4(spark, d):
    return week_suitability(spark, d)


@check(
    "Q5_suitability_band",
    f"""SELECT codigo, nombre, semana, round(real, 4) AS iv_real, round({pct('pool', 0.25)}, 4) AS p25_baseline, round(mediana, 4) AS mediana_baseline,
        round({pct('pool', 0.75)}, 4) AS p75_baseline, round(z, 4) AS anomaly_sigma FROM banda JOIN regiones USING (region)""",
)
def q5(spark, d):
    return E.suitability_of_region(weekly_wide(spark, d, E.suitability_days(CORPUS)), A.regions(spark, d), CORPUS, YEAR)


@check(
    "J12_region_profile",
    """SELECT i.region, i.codigo, i.nombre, iv, anomaly_sigma, probable_percentil, probable_categoria, probable_casos_observados, probable_nota,
        confirmado_percentil, confirmado_categoria, confirmado_casos_observados, confirmado_nota FROM idoneidad_semana i LEFT JOIN presion_semana USING (region)""",
)
def j12(spark, d):
    return E.region_profile(week_suitability(spark, d), week_pressure(spark, d))
