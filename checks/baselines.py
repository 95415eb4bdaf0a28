"""Percentile, channel, label and pressure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BASE_YEARS, LOO, check, classes, history, median, pct, view
from weekwatch.functions import classify, percentiles
from weekwatch.operators import channel, pools, pressure
from weekwatch.plans import adapters as A

KEYS = ["region", "clase"]


def regional(spark, d):
    return A.obs(spark, d).select(*KEYS, "anio", "semana", F.col("conteo").cast("double").alias("valor"))


def national(spark, d):
    return A.obs_national(spark, d).select("anio", "semana", F.col("conteo").cast("double").alias("valor"))


def base(df):
    return df.filter(F.col("anio").isin(*A.BASE_YEARS))


view("serie_base", f"SELECT * FROM serie_nat WHERE anio IN {BASE_YEARS}")
view("serie_reg_base", f"SELECT * FROM serie_reg WHERE anio IN {BASE_YEARS}")
view("hist_base", history("serie_base", "", 1, LOO))
view("hist_reg_base", history("serie_reg_base", "region, clase", 1, LOO))


@check(
    "J3_leave_one_out_window",
    f"""SELECT region, clase, anio, semana, valor, n_obs, anios_presentes,
        coalesce(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in pool], ','), '') AS pool
    FROM hist_reg""",
)
def j3(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.others_in(A.BASE_YEARS))
    return cells.select(
        *KEYS, "anio", "semana", "valor", "n_obs", "anios_presentes",
        F.array_join(F.transform("pool", lambda x: x.cast("bigint").cast("string")), ",").alias("pool"),
    )


@check(
    "J4_leave_one_out_same_week",
    f"""SELECT region, clase, anio, semana, n_obs, anios_presentes, {median('pool')} AS mediana
    FROM ({history('serie_reg', 'region, clase', 0, LOO)})""",
)
def j4(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.others_in(A.BASE_YEARS), window=0)
    return cells.select(
        *KEYS, "anio", "semana", "n_obs", "anios_presentes",
        percentiles.midpoint_median(F.col("pool")).alias("mediana"),
    )


EARLIER = "h.anio < t.anio AND h.anio <> 1998"
view("hist_previa", history("serie_nat", "", 1, EARLIER))
view("hist_previa_reg", history("serie_reg", "region, clase", 1, EARLIER))


@check(
    "J5_expanding_history",
    "SELECT region, clase, anio, semana, n_obs, anios_presentes, pool[1] AS minimo, pool[len(pool)] AS maximo FROM hist_previa_reg",
)
def j5(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.earlier_than([A.EXCLUDED_YEAR]))
    return cells.select(
        *KEYS, "anio", "semana", "n_obs", "anios_presentes",
        F.array_min("pool").alias("minimo"), F.array_max("pool").alias("maximo"),
    )


@check(
    "P1_linear_percentile",
    f"""SELECT region, clase, anio, semana, {pct('pool', 0.25)} AS p25, {pct('pool', 0.5)} AS p50,
        {pct('pool', 0.75)} AS p75, {pct('pool', 0.9)} AS p90 FROM hist_reg""",
)
def p1(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.others_in(A.BASE_YEARS))
    return pools.percentiles(cells, p25=0.25, p50=0.5, p75=0.75, p90=0.9).select(
        *KEYS, "anio", "semana", "p25", "p50", "p75", "p90"
    )


_CHANNEL = f"""SELECT *, n_obs >= 12 AND anios_presentes >= 3 AS suficiente,
        {classes('valor', 'p75', 'p90')} AS clase_p75_p90, {classes('valor', 'p50', 'p75')} AS clase_p50_p75,
        CASE WHEN valor > p75 THEN 'epidemia' WHEN valor > p50 THEN 'alarma' WHEN valor > p25 THEN 'seguridad'
             WHEN p75 IS NOT NULL THEN 'exito' END AS zona
    FROM (SELECT *, {pct('pool', 0.25)} AS p25, {pct('pool', 0.5)} AS p50, {pct('pool', 0.75)} AS p75,
                 {pct('pool', 0.9)} AS p90 FROM %s)"""
view("canal", _CHANNEL % "hist_base")
view("canal_reg", _CHANNEL % "hist_reg_base")


@check(
    "P2_endemic_channel",
    """SELECT anio, semana, valor, n_obs, anios_presentes, suficiente, p25, p50, p75, p90,
        clase_p75_p90, clase_p50_p75, zona FROM canal""",
)
def p2(spark, d):
    return channel.endemic_channel(national(spark, d), [], A.BASE_YEARS)


@check(
    "P3_sufficiency_floors",
    """SELECT n_obs >= 12 AND anios_presentes >= 3 AS piso_canal, anios_presentes >= 3 AS piso_presion, count(*) AS celdas
    FROM hist_reg GROUP BY ALL""",
)
def p3(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.others_in(A.BASE_YEARS))
    return cells.groupBy(
        pools.sufficient().alias("piso_canal"), (F.col("anios_presentes") >= 3).alias("piso_presion")
    ).agg(F.count(F.lit(1)).alias("celdas"))


@check(
    "P4_two_cut_classes",
    """SELECT region, clase, anio, semana, valor, clase_p75_p90, clase_p50_p75 FROM canal_reg""",
)
def p4(spark, d):
    return channel.endemic_channel(regional(spark, d), KEYS, A.BASE_YEARS).select(
        *KEYS, "anio", "semana", "valor", "clase_p75_p90", "clase_p50_p75"
    )


@check("P5_four_zones", "SELECT region, clase, anio, semana, zona FROM canal_reg")
def p5(spark, d):
    return channel.endemic_channel(regional(spark, d), KEYS, A.BASE_YEARS).select(*KEYS, "anio", "semana", "zona")


@check(
    "P6_zone_to_class",
    """SELECT region, clase, anio, semana, CASE zona WHEN 'exito' THEN 'bajo' WHEN 'seguridad' THEN 'bajo'
        WHEN 'alarma' THEN 'medio' WHEN 'epidemia' THEN 'alto' END AS clase_colapsada FROM canal_reg""",
)
def p6(spark, d):
    cells = channel.endemic_channel(regional(spark, d), KEYS, A.BASE_YEARS)
    return channel.with_zone_class(cells).select(*KEYS, "anio", "semana", "clase_colapsada")


@check(
    "J11_scheme_disagreements",
    """SELECT count(*) AS discrepancias, (SELECT count(*) FROM canal_reg WHERE suficiente) AS celdas FROM canal_reg
    WHERE suficiente AND clase_p50_p75 <> CASE zona WHEN 'exito' THEN 'bajo' WHEN 'seguridad' THEN 'bajo'
        WHEN 'alarma' THEN 'medio' WHEN 'epidemia' THEN 'alto' END""",
)
def j11(spark, d):
    cells = channel.with_zone_class(channel.endemic_channel(regional(spark, d), KEYS, A.BASE_YEARS))
    return cells.filter("suficiente").agg(
        F.count_if(F.col("clase_colapsada") != F.col("clase_p50_p75")).alias("discrepancias"),
        F.count(F.lit(1)).alias("celdas"),
    )


@check(
    "A9_class_distribution",
    """SELECT anio, esquema, count(*) FILTER (c = 'bajo') AS bajo, count(*) FILTER (c = 'medio') AS medio,
        count(*) FILTER (c = 'alto') AS alto, count(c) AS total
    FROM (SELECT anio, 'p75_p90' AS esquema, clase_p75_p90 AS c FROM canal WHERE suficiente
          UNION ALL SELECT anio, 'p50_p75', clase_p50_p75 FROM canal WHERE suficiente) GROUP BY ALL""",
)
def a9(spark, d):
    cells = channel.endemic_channel(national(spark, d), [], A.BASE_YEARS).filter("suficiente")
    schemes = cells.select("anio", F.expr("stack(2, 'p75_p90', clase_p75_p90, 'p50_p75', clase_p50_p75) AS (esquema, etiqueta)"))
    return channel.class_distribution(schemes, ["anio", "esquema"])


view(
    "puntos_base",
    f"SELECT region, clase, anio, semana, CAST(valor AS DOUBLE) AS valor FROM puntos WHERE anio IN {BASE_YEARS}",
)


_LABEL = f"""SELECT *, CASE WHEN n_obs >= %d AND anios_presentes >= %d THEN {pct('pool', 0.75)} END AS corte_inferior,
    CASE WHEN n_obs >= %d AND anios_presentes >= %d THEN {pct('pool', 0.9)} END AS corte_superior FROM %s"""


def label_sql(source: str, n: int, y: int) -> str:
    return f"""SELECT * EXCLUDE (pool), {classes('valor', 'corte_inferior', 'corte_superior')} AS etiqueta,
        CASE WHEN NOT (n_obs >= {n} AND anios_presentes >= {y}) THEN 'sin_suficiencia_etiqueta' END AS motivo
        FROM ({_LABEL % (n, y, n, y, source)})"""


view("etiquetas_retro", label_sql("hist_base", 12, 3))
view("etiquetas_retro_reg", label_sql("hist_reg_base", 12, 3))
view("etiquetas", label_sql("hist_previa", 6, 2))
view("etiquetas_reg", label_sql("hist_previa_reg", 6, 2))


@check("P8_retrospective_labels", "SELECT * FROM etiquetas_retro")
def p8(spark, d):
    return channel.retrospective_labels(national(spark, d), [], A.BASE_YEARS).drop("claves")


def prospective(spark, d):
    """Prospective national labels with the floors that suit seven years of data."""
    return channel.prospective_labels(national(spark, d), [], [A.EXCLUDED_YEAR], min_obs=6, min_years=2)


view(
    "linaje",
    f"""SELECT t.anio, t.semana, string_agg(h.anio || '-' || h.semana, ',' ORDER BY h.anio, h.semana) AS linaje
    FROM serie_nat t LEFT JOIN serie_nat h ON h.semana BETWEEN t.semana - 1 AND t.semana + 1 AND {EARLIER} GROUP BY ALL""",
)


@check(
    "P9_prospective_labels",
    "SELECT e.*, coalesce(linaje, '') AS linaje FROM etiquetas e JOIN linaje USING (anio, semana)",
)
def p9(spark, d):
    line = F.array_join(F.transform("claves", lambda c: F.concat_ws("-", c["anio"], c["semana"])), ",")
    return prospective(spark, d).withColumn("linaje", line).drop("claves")


@check("P10_labels_per_key", "SELECT * FROM etiquetas_reg")
def p10(spark, d):
    return channel.prospective_labels(
        regional(spark, d), KEYS, [A.EXCLUDED_YEAR], min_obs=6, min_years=2
    ).drop("claves")


@check(
    "P11_within_year_labels",
    f"""SELECT anio, semana, valor, {pct('pool', 0.5)} AS corte_inferior, {pct('pool', 0.75)} AS corte_superior,
        {classes('valor', pct('pool', 0.5), pct('pool', 0.75))} AS etiqueta
    FROM serie_nat JOIN (SELECT anio, list(valor ORDER BY valor) AS pool FROM serie_nat GROUP BY anio HAVING count(*) = 52)
    USING (anio)""",
)
def p11(spark, d):
    return channel.within_year_labels(national(spark, d), [])


@check(
    "P11_within_year_labels_any_length",
    f"""SELECT region, clase, anio, semana, valor, {classes('valor', pct('pool', 0.5), pct('pool', 0.75))} AS etiqueta
    FROM serie_reg JOIN (SELECT region, clase, anio, list(valor ORDER BY valor) AS pool FROM serie_reg GROUP BY ALL)
    USING (region, clase, anio)""",
)
def p11_any(spark, d):
    return channel.within_year_labels(regional(spark, d), KEYS, required_weeks=None).drop(
        "corte_inferior", "corte_superior"
    )


@check(
    "P12_unpaired_labels",
    f"""SELECT t.anio, semana, valor, {pct('pool', 0.75)} AS corte_inferior, {pct('pool', 0.9)} AS corte_superior,
        {classes('valor', pct('pool', 0.75), pct('pool', 0.9))} AS etiqueta
    FROM serie_base t JOIN (SELECT y.anio, list(h.valor ORDER BY h.valor) AS pool
        FROM (SELECT DISTINCT anio FROM serie_base) y JOIN serie_base h ON h.anio <> y.anio GROUP BY y.anio) p ON p.anio = t.anio""",
)
def p12(spark, d):
    return channel.unpaired_labels(national(spark, d), [], A.BASE_YEARS)


RANK = """CASE WHEN n = 0 OR valor IS NULL THEN NULL
    WHEN n = 1 AND igual = 1 THEN 50.0 WHEN menor = 0 AND igual = 0 THEN 0.0 WHEN menor = n THEN 100.0
    WHEN igual > 0 THEN 100.0 * ((menor + menor + igual - 1) / 2.0) / (n - 1)
    ELSE 100.0 * ((menor - 1) + (valor - pool[menor]) / (pool[menor + 1] - pool[menor])) / (n - 1) END"""
view(
    "rangos",
    f"""SELECT *, CAST({RANK} AS DOUBLE) AS rango FROM (SELECT *, coalesce(len(pool), 0) AS n,
        len([x for x in pool if x < valor]) AS menor, len([x for x in pool if x = valor]) AS igual FROM hist_reg)""",
)


@check("P15_percentile_rank", "SELECT region, clase, anio, semana, round(rango, 6) AS rango FROM rangos")
def p15(spark, d):
    cells = pools.observed_cells(regional(spark, d), KEYS, pools.others_in(A.BASE_YEARS))
    rank = percentiles.percentile_rank(F.col("pool"), F.col("valor"))
    return cells.select(*KEYS, "anio", "semana", F.round(rank, 6).alias("rango"))


_PRESSURE = f"""SELECT *, anios_presentes >= 3 AS basta FROM rangos"""
view(
    "presion",
    f"""SELECT region, clase, anio, semana, valor AS casos_observados,
        CASE WHEN basta THEN round_even(rango, 1) END AS percentil,
        CASE WHEN basta THEN {classes('valor', pct('pool', 0.5), pct('pool', 0.75), ('baja', 'media', 'alta'))} END AS categoria,
        CASE WHEN basta THEN round_even({pct('pool', 0.5)}, 1) END AS p50_baseline,
        CASE WHEN basta THEN round_even({pct('pool', 0.75)}, 1) END AS p75_baseline,
        n_obs AS n_obs_baseline, anios_presentes AS anios_baseline,
        CASE WHEN NOT basta THEN '{pressure.NOTE_INSUFFICIENT}' END AS nota
    FROM ({_PRESSURE})""",
)


@check("P16_pressure_cells", "SELECT * FROM presion")
def p16(spark, d):
    return pressure.observed(regional(spark, d), KEYS, A.BASE_YEARS)
